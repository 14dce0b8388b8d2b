"""Registered queries of term tables: nutation, true places, barycentric light time, tabulated clock offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import ephemeris as ep
from skylattice.plans.common import DAY_SQL, day
from skylattice.plans.sky_queries import JDS, WRAP, _dated
from skylattice.registry import Registry, table

R = Registry()


def _poly_sql(factors) -> str:
    return "+".join(f"({f!r})" + "*t" * i for i, f in enumerate(factors))


def _terms_sql(rows, fn, at) -> str:
    """Sum of a function of multiples of the arguments n0 to n4."""
    return "+".join(f"({r[at]!r}+({r[at + 1]!r})*t)*{fn}(" + "+".join(f"({m!r})*n{i}" for i, m in enumerate(r[:5]) if m) + ")" for r in rows)


_NUT = ep.rows_of(ep.NUTATION)
NUT = f"WITH q AS ({JDS}), c AS (SELECT *, (jd-2451545.0)/36525 AS t FROM q), a AS (SELECT *, " + ", ".join(f"radians({_poly_sql(p)}) AS n{i}" for i, p in enumerate(ep.ARGUMENTS)) + f", radians(({_poly_sql(ep.OBLIQUITY)})/3600) AS tilt FROM c), n AS (SELECT id, lon, lat, tilt, ({_terms_sql(_NUT, 'sin', 5)})/10000 AS psi, ({_terms_sql(_NUT, 'cos', 7)})/10000 AS eps FROM a)"


@R.query("nutation_terms", NUT + " SELECT id, round(psi, 6) AS psi, round(eps, 6) AS eps, round(degrees(tilt), 8) AS tilt FROM n")
def nutation_terms(spark, d):
    """Nutation in longitude and obliquity (arcseconds) and mean obliquity (degrees) at every order's date."""
    n = ep.nutation(_dated(spark, d), "jd")
    return n.select("id", *[F.round(F.degrees(c) * 3600, 6).alias(c) for c in ("psi", "eps")], F.round(F.degrees("tilt"), 8).alias("tilt"))


TRUE = (
    NUT + ", v AS (SELECT id, radians(psi/3600) AS p, tilt AS o, tilt + radians(eps/3600) AS o1, cos(lat)*cos(lon) AS x, cos(lat)*sin(lon) AS y, sin(lat) AS z FROM n), "
    "w AS (SELECT id, cos(p)*x - sin(p)*cos(o)*y - sin(p)*sin(o)*z AS x, sin(p)*cos(o1)*x + (cos(p)*cos(o1)*cos(o)+sin(o1)*sin(o))*y + (cos(p)*cos(o1)*sin(o)-sin(o1)*cos(o))*z AS y, sin(p)*sin(o1)*x + (cos(p)*sin(o1)*cos(o)-cos(o1)*sin(o))*y + (cos(p)*sin(o1)*sin(o)+cos(o1)*cos(o))*z AS z FROM v) "
    f"SELECT id, round({WRAP.format(x='atan2(y, x)')}, 9) AS out_lon, round(atan2(z, sqrt(x*x+y*y)), 9) AS out_lat FROM w"
)


@R.query("true_of_date", TRUE)
def true_of_date(spark, d):
    """Mean places of date turned to true ones by the nutation matrix."""
    t = ep.true_of_date(_dated(spark, d), "jd", "lon", "lat", "out_lon", "out_lat")
    return t.select("id", F.round("out_lon", 9).alias("out_lon"), F.round("out_lat", 9).alias("out_lat"))


def _earth_sql() -> str:
    """Barycentric place and motion of the Earth at every distinct jd of q, as table earth."""
    rows = ep.rows_of(ep.PLANETS)
    values = ", ".join("(" + ", ".join([str(int(k == 2)), *(f"{x!r}::DOUBLE" for x in r)]) + ")" for k, r in enumerate(rows))
    anomaly = "k0 AS (SELECT *, m + e*sin(m) AS x0 FROM o)" + "".join(f", k{i + 1} AS (SELECT *, x{i} - (x{i} - e*sin(x{i}) - m)/(1 - e*cos(x{i})) AS x{i + 1} FROM k{i})" for i in range(ep.STEPS))
    turn = lambda a, b: f"{a}*(cos(w)*cos(n)-sin(w)*sin(n)*cos(i)) - {b}*(sin(w)*cos(n)+cos(w)*sin(n)*cos(i)) AS {{0}}, {a}*(cos(w)*sin(n)+sin(w)*cos(n)*cos(i)) - {b}*(sin(w)*sin(n)-cos(w)*cos(n)*cos(i)) AS {{1}}, {a}*sin(w)*sin(i) + {b}*cos(w)*sin(i) AS {{2}}"
    x = f"x{ep.STEPS}"
    return (
        f"body(home, a, a1, e, e1, i, i1, l, l1, p, p1, n, n1, mass) AS (VALUES {values}), j AS (SELECT DISTINCT jd, (jd-2451545.0)/36525 AS t FROM q), "
        "o AS (SELECT jd, home, a+a1*t AS a, e+e1*t AS e, radians(i+i1*t) AS i, radians(n+n1*t) AS n, radians(p+p1*t-n-n1*t) AS w, radians(mod(mod(l+l1*t-p-p1*t, 360)+360, 360)) AS m, radians(l1-p1)/36525 AS rate, home - 1/mass/(1+(SELECT sum(1/mass) FROM body)) AS share FROM j, body), "
        f"{anomaly}, f AS (SELECT *, a*(cos({x})-e) AS px, a*sqrt(1-e*e)*sin({x}) AS py, -a*rate*sin({x})/(1-e*cos({x})) AS mx, a*rate*sqrt(1-e*e)*cos({x})/(1-e*cos({x})) AS my FROM k{ep.STEPS}), "
        f"g AS (SELECT jd, share, {turn('px', 'py').format('x', 'y', 'z')}, {turn('mx', 'my').format('vx', 'vy', 'vz')} FROM f), s AS (SELECT jd, sum(share*x) AS x, sum(share*y) AS y, sum(share*z) AS z, sum(share*vx) AS vx, sum(share*vy) AS vy, sum(share*vz) AS vz FROM g GROUP BY jd), "
        "l AS (SELECT jd, radians(218.3165+481267.8813*t+6.289*sin(radians(134.963+477198.8676*t))) AS moon FROM j), "
        f"c AS (SELECT jd, x-{ep.EARTH_OFFSET!r}*cos(moon) AS x, y-{ep.EARTH_OFFSET!r}*sin(moon) AS y, z, vx+{ep.EARTH_OFFSET!r}*0.2299715*sin(moon) AS vx, vy-{ep.EARTH_OFFSET!r}*0.2299715*cos(moon) AS vy, vz FROM s JOIN l USING (jd)), "
        f"earth AS (SELECT jd, x, y*cos(k)-z*sin(k) AS y, y*sin(k)+z*cos(k) AS z, vx, vy*cos(k)-vz*sin(k) AS vy, vy*sin(k)+vz*cos(k) AS vz FROM c, (SELECT radians({ep.TILT!r}) AS k))"
    )


@R.query("barycentric_time", f"WITH q AS ({JDS}), {_earth_sql()} SELECT id, round(499.004784*(x*cos(lat)*cos(lon)+y*cos(lat)*sin(lon)+z*sin(lat)), 6) AS delay, round(149597870.7/86400*(vx*cos(lat)*cos(lon)+vy*cos(lat)*sin(lon)+vz*sin(lat)), 6) AS velocity FROM q JOIN earth USING (jd)")
def barycentric_time(spark, d):
    """Light time to the barycentre (seconds) and the Earth's speed towards the direction of every order (km/s)."""
    b = ep.barycentric(_dated(spark, d), "jd", "lon", "lat")
    return b.select("id", F.round("delay", 6).alias("delay"), F.round("velocity", 6).alias("velocity"))


UT1 = (
    f"WITH k AS (SELECT floor({DAY_SQL.format(c='o_orderdate')}/7)*7.0 AS a, avg(o_totalprice)/777777.0 AS u FROM orders GROUP BY 1), i AS (SELECT a, u, lead(a) OVER (ORDER BY a) AS b, lead(u) OVER (ORDER BY a) AS v FROM k), "
    f"x AS (SELECT l_orderkey*8+l_linenumber AS id, {DAY_SQL.format(c='l_shipdate')} + l_linenumber/8.0 AS t FROM lineitem), y AS (SELECT x.id, x.t, i.* FROM x ASOF LEFT JOIN i ON x.t >= i.a) "
    "SELECT id, round(CASE WHEN t = a THEN u WHEN b IS NOT NULL THEN u + (t-a)/(b-a)*(v-u) END, 9) AS offset_s FROM y"
)


@R.query("ut1_from_table", UT1)
def ut1_from_table(spark, d):
    """A clock offset by week (from the orders' totals) at the times of all lines, between both neighbours."""
    known = table(spark, d, "orders").select((F.floor(day("o_orderdate") / 7) * 7).cast("double").alias("a"), (F.col("o_totalprice") / 777777.0).alias("u"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (day("l_shipdate") + F.col("l_linenumber") / 8.0).alias("t"))
    return ep.from_table(li, "t", known, "a", "u", 7.0, "offset_s").select("id", F.round("offset_s", 9).alias("offset_s"))
