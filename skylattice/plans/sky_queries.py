"""Registered queries of sky geometry, times, units, periods, photons and robust statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import solar, sphere, text, times, units
from skylattice.operators import catalogs as ca
from skylattice.operators import movers as mv
from skylattice.operators import periods as pr
from skylattice.operators import sequence as sq
from skylattice.operators import spatial as sp
from skylattice.operators import stats as st
from skylattice.operators import tables as tb
from skylattice.plans.common import LC_SQL, day, light_curve, rounded
from skylattice.plans.series_queries import CENTRED, FREQS, FSQL, MAG, _mags
from skylattice.plans.spatial_queries import CS, DIST, PART, _cs, _plane
from skylattice.plans.table_queries import ACOS, PA, WRAP, XY, _four, _q
from skylattice.registry import Registry, table

R = Registry()
LC = f"WITH {LC_SQL} "
UNIT = ("cos(lat)*cos(lon)", "cos(lat)*sin(lon)", "sin(lat)")


def _r(df, **cols):
    """Named columns, rounded to six digits."""
    return df.select("id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def _lonlat_sql(x, y, z):
    return f"round({WRAP.format(x=f'atan2({y},{x})')}, 6) AS out_lon, round(atan2({z}, sqrt(({x})*({x})+({y})*({y}))), 6) AS out_lat"


# directions

@R.query("hour_angle", XY + f"SELECT id, round({WRAP.format(x='atan2(-cos(lat)*sin(lon), sin(lat)*cos(0.53)-cos(lat)*cos(lon)*sin(0.53))')}, 6) AS ha, round(asin(sin(lat)*sin(0.53)+cos(lat)*cos(lon)*cos(0.53)), 6) AS dec FROM q")
def hour_angle(spark, d):
    ha, dec = sphere.hadec(F.col("lon"), F.col("lat"), 0.53)
    return _r(_q(spark, d), ha=ha, dec=dec)


@R.query("parallactic_angle", XY + "SELECT id, round(atan2(sin(lon), tan(0.53)*cos(lat)-sin(lat)*cos(lon)), 6) AS pa FROM q")
def parallactic_angle(spark, d):
    return _r(_q(spark, d), pa=sphere.parallactic_angle(F.col("lon"), F.col("lat"), 0.53))


@R.query("refraction", XY + "SELECT id, round(radians(1.02/tan(radians(a+10.3/(a+5.11)))/60)*1000, 6) AS milli FROM (SELECT id, degrees(abs(lat)+0.1) AS a FROM q)")
def refraction(spark, d):
    return _r(_q(spark, d), milli=sphere.refraction(F.abs("lat") + 0.1) * 1000)


MOVED = "asin(least(1.0, greatest(-1.0, sin(lat)*cos({x})+cos(lat)*sin({x})*cos({a}))))"
MOVED_LON = WRAP.format(x="lon+atan2(sin({a})*sin({x})*cos(lat), cos({x})-sin(lat)*sin(" + MOVED + "))")


@R.query("add_offset", XY + f"SELECT id, round({MOVED_LON.format(x='0.2', a='1.1')}, 6) AS out_lon, round({MOVED.format(x='0.2', a='1.1')}, 6) AS out_lat FROM q")
def add_offset(spark, d):
    lo, la = sphere.move(F.col("lon"), F.col("lat"), F.lit(0.2), F.lit(1.1))
    return _r(_q(spark, d), out_lon=lo, out_lat=la)


@R.query("apply_proper_motion", XY + f"SELECT id, round({MOVED_LON.format(x='0.05', a='atan2(0.03, 0.04)')}, 6) AS out_lon, round({MOVED.format(x='0.05', a='atan2(0.03, 0.04)')}, 6) AS out_lat FROM q")
def apply_proper_motion(spark, d):
    lo, la = sphere.proper_motion(F.col("lon"), F.col("lat"), F.lit(0.003), F.lit(0.004), F.lit(10.0))
    return _r(_q(spark, d), out_lon=lo, out_lat=la)


@R.query("aberration", XY + "SELECT id, " + _lonlat_sql(*[f"{u}+({v})" for u, v in zip(UNIT, ("0.0001", "-0.00005", "0.00002"), strict=True)]) + " FROM q")
def aberration(spark, d):
    lo, la = sphere.aberrated(F.col("lon"), F.col("lat"), (0.0001, -0.00005, 0.00002))
    return _r(_q(spark, d), out_lon=lo, out_lat=la)


TRIANGLE = [("l0", "b0"), ("lon", "lat"), ("lon+0.3", "lat*0.5")]


def _tri_sql(corners):
    v = [[f"cos({b})*cos({a})", f"cos({b})*sin({a})", f"sin({b})"] for a, b in corners]
    dot = lambda a, b: "(" + "+".join(f"({x})*({y})" for x, y in zip(a, b, strict=True)) + ")"
    a, b, c = v
    cross = [f"(({b[1]})*({c[2]})-({b[2]})*({c[1]}))", f"(({b[2]})*({c[0]})-({b[0]})*({c[2]}))", f"(({b[0]})*({c[1]})-({b[1]})*({c[0]}))"]
    return f"2*atan2(abs({dot(a, cross)}), 1+{dot(a, b)}+{dot(b, c)}+{dot(c, a)})"


@R.query("triangle_area", XY + f"SELECT id, round({_tri_sql(TRIANGLE)}, 6) AS area FROM q")
def triangle_area(spark, d):
    q = _q(spark, d)
    return _r(q, area=sphere.triangle_area(*[sphere.unit_vector(F.expr(a), F.expr(b)) for a, b in TRIANGLE]))


BOX = [("lon", "lat*0.5"), ("lon+0.2", "lat*0.5"), ("lon+0.25", "lat*0.5+0.2"), ("lon+0.05", "lat*0.5+0.25")]


@R.query("polygon_area", XY + f"SELECT id, round({_tri_sql(BOX[:3])}+{_tri_sql([BOX[0], *BOX[2:]])}, 6) AS area FROM q")
def polygon_area(spark, d):
    return _r(_q(spark, d), area=sphere.polygon_area([(F.expr(a), F.expr(b)) for a, b in BOX]))


@R.query("point_to_great_circle", XY + f"SELECT id, round(abs(pi()/2 - {ACOS}), 6) AS dist FROM q")
def point_to_great_circle(spark, d):
    return _r(_q(spark, d), dist=sphere.point_to_great_circle(F.col("lon"), F.col("lat"), F.col("l0"), F.col("b0")))


@R.query("cross_product", XY + "SELECT id, round(cos(lat)*sin(lon)*0.5 - sin(lat)*0.25, 6) AS x, round(sin(lat)*0.75 - cos(lat)*cos(lon)*0.5, 6) AS y, round(cos(lat)*cos(lon)*0.25 - cos(lat)*sin(lon)*0.75, 6) AS z FROM q")
def cross_product(spark, d):
    x, y, z = sphere.cross(sphere.unit_vector(F.col("lon"), F.col("lat")), (F.lit(0.75), F.lit(0.25), F.lit(0.5)))
    return _r(_q(spark, d), x=x, y=y, z=z)


HA = WRAP.format(x="2.0-lon")


@R.query("insert_azalt", XY + f"SELECT id, round({WRAP.format(x='atan2(-cos(lat)*sin(2.0-lon), sin(lat)*cos(0.53)-cos(lat)*cos(2.0-lon)*sin(0.53))')}, 6) AS az, round(asin(sin(lat)*sin(0.53)+cos(lat)*cos(2.0-lon)*cos(0.53)), 6) AS alt FROM q")
def insert_azalt(spark, d):
    """Azimuth and altitude of a catalog at a sidereal time of 2 radians."""
    az, alt = sphere.altaz(2.0 - F.col("lon"), F.col("lat"), 0.53)
    return _r(_q(spark, d), az=az, alt=alt)


@R.query("coordinate_ok", XY + f", a AS (SELECT id, asin(sin(lat)*sin(0.53)+cos(lat)*cos(2.0-lon)*cos(0.53)) AS alt, {HA} AS ha FROM q), s AS (SELECT id, alt, ha, 1/cos(pi()/2-alt)-1 AS s FROM a) SELECT id, alt > 0.3003 AND 1+s-0.0018167*s-0.002875*s*s-0.0008083*s*s*s < 2.5003 AND abs(CASE WHEN ha > pi() THEN ha-2*pi() ELSE ha END) < 1.2003 AS ok FROM s")
def coordinate_ok(spark, d):
    return _q(spark, d).select("id", sphere.observable(2.0 - F.col("lon"), F.col("lat"), 0.53, 0.3003, 2.5003, 1.2003).alias("ok"))


POLES = [(0.4, 1.2), (2.1, -0.1), (4.0, 0.3)]


@R.query("cone_in_polysphere", XY + "SELECT id FROM q WHERE " + " AND ".join(f"acos(least(1.0, greatest(-1.0, sin(lat)*sin({b})+cos(lat)*cos({b})*cos(lon-{a})))) < pi()/2+0.1001" for a, b in POLES))
def cone_in_polysphere(spark, d):
    return _q(spark, d).where(sphere.cone_meets_polygon(F.col("lon"), F.col("lat"), 0.1001, POLES)).select("id")


@R.query("gnomonic", XY + "SELECT id, round(cos(lat)*sin(lon-1.0)/c, 6) AS x, round((cos(0.2)*sin(lat)-sin(0.2)*cos(lat)*cos(lon-1.0))/c, 6) AS y FROM (SELECT *, sin(0.2)*sin(lat)+cos(0.2)*cos(lat)*cos(lon-1.0) AS c FROM q) WHERE c > 0.3003")
def gnomonic(spark, d):
    q = _q(spark, d).where(math.sin(0.2) * F.sin("lat") + math.cos(0.2) * F.cos("lat") * F.cos(F.col("lon") - 1.0) > 0.3003)
    x, y = sphere.gnomonic(F.col("lon"), F.col("lat"), 1.0, 0.2)
    return _r(q, x=x, y=y)


JDS = "SELECT o_orderkey AS id, epoch_us(o_orderdate)/86400000000.0 + 2440587.5 AS jd, radians(mod(o_orderkey*7919, 36000)/100.0) AS lon, radians(mod(o_orderkey*104729, 17000)/100.0 - 85.0) AS lat FROM orders"
SUN = f"WITH q AS ({JDS}), n AS (SELECT *, jd-2451545.0 AS n FROM q), g AS (SELECT *, radians(357.528+0.9856003*n) AS g, radians(23.439-0.0000004*n) AS tilt FROM n), l AS (SELECT *, radians(280.460+0.9856474*n)+radians(1.915*sin(g)+0.020*sin(2*g)) AS sl, 1.00014-0.01671*cos(g)-0.00014*cos(2*g) AS r FROM g), s AS (SELECT *, r*cos(sl) AS sx, r*cos(tilt)*sin(sl) AS sy, r*sin(tilt)*sin(sl) AS sz FROM l) "


def _dated(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), times.jd(F.col("o_orderdate")).alias("jd"), F.radians(F.pmod(k * 7919, F.lit(36000)) / 100.0).alias("lon"), F.radians(F.pmod(k * 104729, F.lit(17000)) / 100.0 - 85.0).alias("lat"))


@R.query("heliocentric_time", SUN + "SELECT id, round(-(sx*cos(lat)*cos(lon)+sy*cos(lat)*sin(lon)+sz*sin(lat))*499.004784, 4) AS seconds FROM s")
def heliocentric_time(spark, d):
    return _dated(spark, d).select("id", F.round(solar.sun_delay(F.col("jd"), F.col("lon"), F.col("lat")), 4).alias("seconds"))


@R.query("motion_and_parallax", SUN + ", v AS (SELECT id, cos(lat)*cos(lon)+5*(0.0002*-sin(lon)+0.0001*-sin(lat)*cos(lon))+0.001*sx AS x, cos(lat)*sin(lon)+5*(0.0002*cos(lon)+0.0001*-sin(lat)*sin(lon))+0.001*sy AS y, sin(lat)+5*(0.0001*cos(lat))+0.001*sz AS z FROM s) SELECT id, " + _lonlat_sql("x", "y", "z") + " FROM v")
def motion_and_parallax(spark, d):
    lo, la = solar.with_parallax(F.col("jd"), F.col("lon"), F.col("lat"), F.lit(0.0002), F.lit(0.0001), F.lit(0.001), F.lit(5.0))
    return _r(_dated(spark, d), out_lon=lo, out_lat=la)


@R.query("nutation", f"WITH q AS ({JDS}), t AS (SELECT id, (jd-2451545.0)/36525 AS t FROM q), a AS (SELECT id, radians(125.04452-1934.136261*t) AS o, radians(280.4665+36000.7698*t) AS s, radians(218.3165+481267.8813*t) AS m FROM t) SELECT id, round(-17.20*sin(o)-1.32*sin(2*s)-0.23*sin(2*m)+0.21*sin(2*o), 5) AS psi, round(9.20*cos(o)+0.57*cos(2*s)+0.10*cos(2*m)-0.09*cos(2*o), 5) AS eps FROM a")
def nutation(spark, d):
    psi, eps = solar.nutation(F.col("jd"))
    return _dated(spark, d).select("id", F.round(F.degrees(psi) * 3600, 5).alias("psi"), F.round(F.degrees(eps) * 3600, 5).alias("eps"))


SMALL = "SELECT p_partkey AS id, 1.5+p_size/20.0 AS r, 0.8+p_size/25.0 AS delta, radians(p_size) AS a, p_retailprice/100 AS mag, 2460000.5+p_partkey*0.37 AS jd FROM part"


@R.query("fold_small_body", f"WITH q AS ({SMALL}) SELECT id, round(x-floor(x), 5) AS phase, round(mag-5*log10(r*delta)+2.5*log10(0.85*exp(-3.33*pow(tan(a/2), 0.63))+0.15*exp(-1.87*pow(tan(a/2), 1.22))), 6) AS mag FROM (SELECT *, (jd-delta*499.004784/86400-2460000.0)/0.77 AS x FROM q)")
def fold_small_body(spark, d):
    """Folded at the time the light left, with the magnitude at unit distances."""
    from skylattice.operators.timeseries import phase

    s = F.col("p_size")
    q = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (1.5 + s / 20.0).alias("r"), (0.8 + s / 25.0).alias("delta"), F.radians(s).alias("a"), (F.col("p_retailprice") / 100).alias("mag"), (2460000.5 + F.col("p_partkey") * 0.37).alias("jd"))
    p = phase(solar.left_at(F.col("jd"), F.col("delta")), 2460000.0, 0.77)
    return q.select("id", F.round(p, 5).alias("phase"), F.round(solar.reduced_magnitude(F.col("mag"), F.col("r"), F.col("delta"), F.col("a")), 6).alias("mag"))


# times and units

@R.query("time_types", f"WITH q AS ({JDS}) SELECT id, round(jd-2400000.5, 5) AS mjd, round(1900+(jd-2415020.3135)/365.242189, 6) AS byear, round(2451545.0+(year(make_timestamp(((jd-2440587.5)*86400000000)::BIGINT))-2000)*365.25, 2)::DOUBLE AS year_jd FROM q")
def time_types(spark, d):
    q = table(spark, d, "orders")
    j = times.jd(F.col("o_orderdate"))
    return q.select(F.col("o_orderkey").alias("id"), F.round(times.mjd(j), 5).alias("mjd"), F.round(times.besselian_year(j), 6).alias("byear"), F.round(times.jd_of_julian_year(F.year("o_orderdate")), 2).alias("year_jd"))


@R.query("day_fraction", "SELECT event_id, round((hour(ts)*3600+minute(ts)*60+second(ts))/86400.0, 9) AS frac FROM events")
def day_fraction(spark, d):
    t = F.col("ts")
    return table(spark, d, "events").select("event_id", F.round(times.day_fraction(F.hour(t), F.minute(t), F.second(t)), 9).alias("frac"))


@R.query("easter", "WITH y AS (SELECT DISTINCT 1583 + p_partkey % 1000 AS y FROM part), a AS (SELECT y, y%19 AS a, y//100 AS b, y%100 AS c FROM y), h AS (SELECT *, (19*a+b-b//4-(b-(b+8)//25+1)//3+15)%30 AS h FROM a), e AS (SELECT *, (32+2*(b%4)+2*(c//4)-h-c%4)%7 AS e FROM h), n AS (SELECT y, h+e-7*((a+11*h+22*e)//451)+114 AS n FROM e) SELECT y, (n//31)::INT AS month, (n%31+1)::INT AS day FROM n")
def easter(spark, d):
    m, dd = times.easter(F.col("y"))
    return table(spark, d, "part").select((1583 + F.col("p_partkey") % 1000).alias("y")).distinct().select("y", m.alias("month"), dd.alias("day"))


@R.query("tt_utc", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 32 WHEN o_orderdate >= TIMESTAMP '1997-07-01' THEN 31 WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 30 WHEN o_orderdate >= TIMESTAMP '1994-07-01' THEN 29 WHEN o_orderdate >= TIMESTAMP '1993-07-01' THEN 28 WHEN o_orderdate >= TIMESTAMP '1992-07-01' THEN 27 WHEN o_orderdate >= TIMESTAMP '1991-01-01' THEN 26 END + 32.184::DOUBLE AS tt FROM orders")
def tt_utc(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.tt_utc(times.jd(F.col("o_orderdate"))).alias("tt"))


@R.query("date_strings", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd FROM orders")
def date_strings(spark, d):
    """Timestamp to text in two formats and back to its parts."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("other"))
    back, other = F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss"), F.to_date("other", "dd/MM/yyyy")
    return o.select("o_orderkey", "iso", F.year(back).alias("y"), F.month(other).alias("m"), F.dayofmonth(back).alias("dd"))


@R.query("photon_energy", "SELECT p_partkey, round(6.62607015e-34*299792458.0/(p_retailprice*1e-10)/1.602176634e-19, 7) AS ev, round(p_size*1.602176634e-16/6.62607015e-34/1e15, 4) AS hz FROM part")
def photon_energy(spark, d):
    ev, hz = units.photon_energy(F.col("p_retailprice"), "ang", "ev"), units.photon_energy(F.col("p_size"), "kev", "hz")
    return table(spark, d, "part").select("p_partkey", F.round(ev, 7).alias("ev"), F.round(hz / 1e15, 4).alias("hz"))


@R.query("flux_density", "SELECT p_partkey, round(-2.5*log10(p_size*1e-23)-48.6, 6) AS ab, round(p_size*1e-23*2.99792458e18/(p_retailprice*p_retailprice)*1e10, 6) AS per_angstrom, round(pow(10, -0.4*(p_size/2.0+48.6))/1e-23*1000, 2) AS mjy FROM part")
def flux_density(spark, d):
    w, v = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(units.flux_density(v, "jy", "ab", w), 6).alias("ab"), F.round(units.flux_density(v, "jy", "angstrom", w) * 1e10, 6).alias("per_angstrom"), F.round(units.flux_density(v / 2, "ab", "mjy", w), 2).alias("mjy"))


@R.query("small_functions", "SELECT p_partkey, p_size % 2 = 0 AS even, least(greatest(p_size-10, 1), 30)::INT AS lo, least(greatest(p_size+5, 1), 30)::INT AS hi, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(8*pow(x, 4)-8*x*x+1, 9) AS t4 FROM (SELECT *, p_size/50.0 AS x FROM part)")
def small_functions(spark, d):
    s = F.col("p_size")
    lo, hi = text.clamped(s - 10, s + 5, 30)
    return table(spark, d, "part").select("p_partkey", (s % 2 == 0).alias("even"), lo.alias("lo"), hi.alias("hi"), F.round(F.sin(s), 9).alias("s"), F.round(F.cos(s), 9).alias("c"), F.round(text.chebyshev(s / 50.0, 4), 9).alias("t4"))


# periods

@R.query("period_two_harmonics", CENTRED + "SELECT source, round(freq, 4) AS freq, round((pow(sum(m*cos(2*pi()*freq*t)),2)+pow(sum(m*sin(2*pi()*freq*t)),2)+pow(sum(m*cos(4*pi()*freq*t)),2)+pow(sum(m*sin(4*pi()*freq*t)),2))/any_value(n)/any_value(var), 5) AS power FROM f JOIN st USING (source) GROUP BY source, freq")
def period_two_harmonics(spark, d):
    return pr.two_harmonics(light_curve(spark, d), "t", "flux", ["source"], FREQS).select("source", F.round("freq", 4).alias("freq"), F.round("power", 5).alias("power"))


@R.query("period_complex", CENTRED + "SELECT source, round(freq, 4) AS freq, round(sum(m*cos(2*pi()*freq*t))/1000, 3) AS re, round(-sum(m*sin(2*pi()*freq*t))/1000, 3) AS im FROM f GROUP BY source, freq")
def period_complex(spark, d):
    s = pr.fourier_sums(light_curve(spark, d), "t", "flux", ["source"], FREQS)
    return s.select("source", F.round("freq", 4).alias("freq"), F.round(F.col("re") / 1000, 3).alias("re"), F.round(F.col("im") / 1000, 3).alias("im"))


@R.query("period_information", LC + f", r AS (SELECT source, min(flux) AS lo, max(flux) AS hi FROM lc GROUP BY 1), c AS (SELECT source, freq, floor((t*freq-floor(t*freq))*6) AS i, least(5, floor((flux-lo)/(hi-lo)*6)) AS j, count(*) AS c FROM lc JOIN r USING (source), {FSQL} GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY source, freq) AS n, sum(c) OVER (PARTITION BY source, freq, i) AS ni, sum(c) OVER (PARTITION BY source, freq, j) AS nj FROM c) SELECT source, round(freq, 4) AS freq, round(sum(c/n*ln(c*n/(ni*nj))), 6) AS information FROM w GROUP BY source, freq")
def period_information(spark, d):
    s = pr.phase_information(light_curve(spark, d), "t", "flux", ["source"], FREQS, 6)
    return s.select("source", F.round("freq", 4).alias("freq"), F.round("information", 6).alias("information"))


KEYED = "k AS (SELECT l_suppkey AS source, l_orderkey*8+l_linenumber AS id, {t} AS t, avg(l_extendedprice) AS flux FROM lineitem GROUP BY ALL)"


@R.query("period_bootstrap", "WITH k AS (SELECT l_suppkey AS source, l_orderkey*8+l_linenumber AS id, min(epoch_us(l_shipdate))/86400000000.0 AS t, min(l_extendedprice) AS flux FROM lineitem GROUP BY 1, 2), m AS (SELECT source, id, t, flux - avg(flux) OVER w AS m, count(*) OVER w AS n, var_samp(flux) OVER w AS var FROM k WINDOW w AS (PARTITION BY source)), s AS (SELECT m.*, sim FROM m, (SELECT unnest(range(0, 6)) AS sim)), a AS (SELECT source, sim, t, n, var, row_number() OVER (PARTITION BY source, sim ORDER BY id) AS k FROM s), b AS (SELECT source, sim, m, row_number() OVER (PARTITION BY source, sim ORDER BY CASE sim WHEN 0 THEN lpad(id::VARCHAR, 32, '0') ELSE md5(id || ':' || sim) END, id) AS k FROM s), p AS (SELECT source, sim, (pow(sum(m*cos(2*pi()*0.05*t)),2)+pow(sum(m*sin(2*pi()*0.05*t)),2))/any_value(n)/any_value(var) AS p FROM a JOIN b USING (source, sim, k) GROUP BY source, sim) SELECT p.source, round(q.p, 5) AS power, count(*) FILTER (p.p >= q.p) AS n_above FROM p JOIN p q ON p.source = q.source AND q.sim = 0 WHERE p.sim > 0 GROUP BY p.source, q.p")
def period_bootstrap(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.min(day("l_shipdate")).alias("t"), F.min("l_extendedprice").alias("flux"))
    return pr.shuffled_power(li, "id", "t", "flux", ["source"], 0.05, 5).select("source", F.round("power", 5).alias("power"), "n_above")


@R.query("interpolate_positions", f"WITH {CS}, p AS (SELECT id, id // 4 AS k, id % 4 AS t, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM c), m AS (SELECT k, t, (x+nx)/2 AS x, (y+ny)/2 AS y, (z+nz)/2 AS z FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM p WINDOW w AS (PARTITION BY k ORDER BY t)) WHERE nx IS NOT NULL) SELECT k, (t + 0.5)::DOUBLE AS t, round(degrees(atan2(y, x)) + CASE WHEN atan2(y, x) < 0 THEN 360 ELSE 0 END, 5) AS ra, round(degrees(atan2(z, sqrt(x*x+y*y))), 5) AS dec FROM m")
def interpolate_positions(spark, d):
    """Positions halfway between those of an object, by unit vectors, also across the origin and near the poles."""
    x, y, z = sphere.unit_vector(F.radians("ra"), F.radians("dec"))
    p = _cs(spark, d)[0].select(F.floor(F.col("id") / 4).alias("k"), (F.col("id") % 4).alias("t"), x.alias("x"), y.alias("y"), z.alias("z"))
    w = Window.partitionBy("k").orderBy("t")
    mid = p.select("k", (F.col("t") + 0.5).cast("double").alias("t"), *[((F.col(c) + F.lead(c).over(w)) / 2).alias(c) for c in "xyz"]).where("x is not null")
    lo, la = sphere.from_unit_vector(F.col("x"), F.col("y"), F.col("z"))
    return mid.select("k", "t", F.round(F.degrees(lo), 5).alias("ra"), F.round(F.degrees(la), 5).alias("dec"))


@R.query("subtract_background", "WITH dd AS (SELECT l_suppkey AS source, floor(epoch_us(l_shipdate)/86400000000.0/30)::BIGINT AS e, avg(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2) SELECT source, e, round(f - median(f) OVER (PARTITION BY source ORDER BY e ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 7) AS sub FROM dd")
def subtract_background(spark, d):
    e = light_curve(spark, d).groupBy("source", F.floor(F.col("t") / 30).alias("e")).agg(F.avg("flux").alias("f"))
    w = Window.partitionBy("source").orderBy("e").rowsBetween(-5, 5)
    return e.select("source", "e", F.round(F.col("f") - sq.running_median("f", w), 7).alias("sub"))


# photons and alerts

EVENT_SKY = "e AS (SELECT event_id, event_type, value, epoch_us(ts)/1000000.0 AS s, (mod(event_id*7919, 36000)/100.0)::DOUBLE AS ra, (mod(event_id*104729, 17000)/100.0 - 85.0)::DOUBLE AS dec FROM events)"


def _event_sky(spark, d):
    return sp.sky(table(spark, d, "events"), "event_id").select(F.col("event_id").alias("id"), "ra", "dec", "event_type", "value", "ts")


@R.query("source_photons", f"WITH {CS}, {EVENT_SKY}, h AS (SELECT s.id AS source, e.event_id, {DIST.format(a='s.', b='e.')} AS dist FROM s, e WHERE {DIST.format(a='s.', b='e.')} <= 2.0) SELECT source, event_id, round(dist, 6) AS dist FROM h")
def source_photons(spark, d):
    """Events around each source of a list."""
    p = sp.zone_pairs(_cs(spark, d)[1], _event_sky(spark, d), 2.0)
    return p.select(F.col("probe_id").alias("source"), F.col("cat_id").alias("event_id"), F.round("dist", 6).alias("dist"))


@R.query("photon_background", f"WITH {CS}, {EVENT_SKY}, far AS (SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE {DIST.format(a='s.', b='e.')} <= 2.0)), n AS (SELECT (SELECT count(*) FROM far) AS n, (SELECT count(*) FROM s) AS k) SELECT n, round(n/(41252.96124941928 - k*360.0*degrees(1-cos(radians(2.0)))), 9) AS per_degree, round(sqrt(n)/(41252.96124941928 - k*360.0*degrees(1-cos(radians(2.0)))), 9) AS error FROM n")
def photon_background(spark, d):
    """Poisson rate a square degree of events away from all sources, their circles taken off the sphere."""
    s, e = _cs(spark, d)[1], _event_sky(spark, d)
    n = sp.unmatched(e, sp.matched(e, s, 2.0), "probe_id").agg(F.count("*").alias("n")).join(F.broadcast(s.agg(F.count("*").alias("k"))))
    area = 41252.96124941928 - F.col("k") * 360.0 * math.degrees(1 - math.cos(math.radians(2.0)))
    return n.select("n", F.round(F.col("n") / area, 9).alias("per_degree"), F.round(F.sqrt("n") / area, 9).alias("error"))


@R.query("select_alerts", "SELECT event_id, user_id, ts FROM (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events WHERE event_type IN ('error', 'purchase') AND value > 2.0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL '6 hours')")
def select_alerts(spark, d):
    """What a poll of an alert table returns: rows of some kinds since a time."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("__last"))
    new = e.where(F.col("event_type").isin("error", "purchase") & (F.col("value") > 2.0)).join(F.broadcast(last)).where(F.col("ts") >= F.col("__last") - F.expr("INTERVAL 6 HOURS"))
    return new.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


# statistics and matches

@R.query("median_sparse", LC + "SELECT source, round(median(flux), 6) AS med FROM (SELECT source, flux, row_number() OVER (PARTITION BY source ORDER BY t, id, flux) AS k FROM lc) WHERE k % 10 = 1 GROUP BY source")
def median_sparse(spark, d):
    """Median of every tenth sample."""
    return rounded(st.median_sparse(light_curve(spark, d), "flux", ["source"], ["t", "id", "flux"], 10), "med")


@R.query("mode_moments", LC + ", b AS (SELECT source, floor(flux/2000)::BIGINT AS b, count(*) AS c FROM lc GROUP BY 1, 2), m AS (SELECT source, arg_min(b, (-c, b)) AS top FROM b GROUP BY source), n AS (SELECT b.source, c, (b+0.5)*2000 AS x FROM b JOIN m ON b.source = m.source AND abs(b - top) <= 5) SELECT source, round(sum(c*x)/sum(c), 4) AS mode, round(sqrt(sum(c*x*x)/sum(c) - pow(sum(c*x)/sum(c), 2)), 3) AS std FROM n GROUP BY source")
def mode_moments(spark, d):
    m = st.mode_moments(light_curve(spark, d), "flux", ["source"], 2000.0, 5)
    return m.select("source", F.round("mode", 4).alias("mode"), F.round("std", 3).alias("std"))


@R.query("robust_zero_point", MAG + ", r AS (SELECT source, median(mag) AS ref FROM m GROUP BY source), x AS (SELECT e, mag - ref AS x FROM m JOIN r USING (source)), c AS (SELECT e, median(x) AS med, (quantile_cont(x, 0.75)-quantile_cont(x, 0.25))/2*1.4826 AS sd FROM x GROUP BY e) SELECT e, round(median(x), 6) AS zp, round(coalesce(stddev_samp(x), 0)/sqrt(count(*)), 6) AS zp_err, count(*) AS n FROM x JOIN c USING (e) WHERE abs(x-med) <= 2.5*sd GROUP BY e")
def robust_zero_point(spark, d):
    """Median offset from calibrated magnitudes after one clip at 2.5 robust deviations."""
    m = _mags(spark, d)
    x = m.join(m.groupBy("source").agg(F.median("mag").alias("ref")), "source").select("e", (F.col("mag") - F.col("ref")).alias("x"))
    return rounded(ca.robust_zero_point(x, "x", ["e"], 2.5), "zp", "zp_err")


@R.query("nearest_value", "SELECT c_custkey, arg_min(s_suppkey, (abs(s_acctbal-c_acctbal), s_acctbal, s_suppkey)) AS near FROM customer, supplier GROUP BY c_custkey")
def nearest_value(spark, d):
    """The entry of a sorted list nearest to each value (smaller value, then smaller key, on ties)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("x"))
    return sq.nearest_value(c, s, "x", 500.0).select(F.col("id").alias("c_custkey"), F.col("key").alias("near"))


@R.query("nearest_bright", f"WITH {CS}, z AS (SELECT 200.0 AS ra, -30.0 AS dec) SELECT c.id, round({DIST.format(a='c.', b='z.')}, 6) AS dist FROM c JOIN customer ON c_custkey = c.id, z WHERE c_acctbal < 2000 ORDER BY {DIST.format(a='c.', b='z.')}, c.id LIMIT 5")
def nearest_bright(spark, d):
    bright = table(spark, d, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("id"))
    return rounded(sp.cone(_cs(spark, d)[0].join(bright, "id"), 200.0, -30.0, 180.0).orderBy("dist", "id").limit(5), "dist").select("id", "dist")


@R.query("select_target", XY + f", t AS (SELECT id, asin(sin(lat)*sin(0.53)+cos(lat)*cos(2.0-lon)*cos(0.53)) AS alt, abs(c_acctbal)/1000 AS w FROM q JOIN customer ON c_custkey = id), p AS (SELECT id, CASE WHEN w < 0.7 THEN 1.1/(1+exp(-(w-0.7)/0.5)) ELSE 1.0+(1.1-1.0)*exp(-(w-0.7)/2.0) END AS p FROM t WHERE alt > 0.5003) SELECT id, round(p, 9) AS priority FROM p ORDER BY round(p, 9) DESC, id LIMIT 10")
def select_target(spark, d):
    """Targets high enough at a sidereal time, by the weight of their waiting time."""
    from skylattice.functions.schedule import cadence_weight

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 1000).alias("w"))
    up = _q(spark, d).where(sphere.altaz(2.0 - F.col("lon"), F.col("lat"), 0.53)[1] > 0.5003).join(c, "id")
    return up.select("id", F.round(cadence_weight(F.col("w")), 9).alias("priority")).orderBy(F.desc("priority"), "id").limit(10)


@R.query("matched_columns", f"WITH {CS}, p AS (SELECT c.id AS probe_id, s.id AS cat_id, {DIST.format(a='c.', b='s.')} AS dist FROM c, s), n AS (SELECT probe_id, arg_min(cat_id, (dist, cat_id)) AS cat_id FROM p WHERE dist <= 4.0 GROUP BY probe_id) SELECT c.id, s_name, s_acctbal FROM c LEFT JOIN n ON probe_id = c.id LEFT JOIN supplier ON s_suppkey = cat_id")
def matched_columns(spark, d):
    """Columns of the nearest row of another catalog, null without one."""
    c, s = _cs(spark, d)
    n = sp.nearest_partner(c, s, 4.0).select(F.col("probe_id").alias("id"), F.col("cat_id").alias("s_suppkey"))
    return c.select("id").join(n, "id", "left").join(table(spark, d, "supplier"), "s_suppkey", "left").select("id", "s_name", "s_acctbal")


@R.query("match_many_catalogs", f"WITH {CS}, {EVENT_SKY}, p AS (SELECT s.id AS sid, c.id AS cid, {DIST.format(a='s.', b='c.')} AS dist FROM s, c), n AS (SELECT sid, count(*) AS n_customers FROM p WHERE dist <= 3.0 GROUP BY sid), v AS (SELECT s.id AS sid, count(*) AS n_events FROM s, e WHERE {DIST.format(a='s.', b='e.')} <= 3.0 GROUP BY s.id) SELECT id, coalesce(n_customers, 0) AS n_customers, coalesce(n_events, 0) AS n_events FROM s LEFT JOIN n ON n.sid = id LEFT JOIN v ON v.sid = id")
def match_many_catalogs(spark, d):
    """Partners of a source list in several catalogs."""
    c, s = _cs(spark, d)
    out = s.select("id")
    for name, other in (("n_customers", c), ("n_events", _event_sky(spark, d))):
        n = sp.matched(s, other, 3.0).select(F.col("probe_id").alias("id"), F.col("n_match").alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@R.query("known_moving", f"WITH {CS}, c2 AS (SELECT c.id, ra, dec, c_nationkey*1.0 AS t FROM c JOIN customer ON c_custkey = c.id), o AS (SELECT s.id AS obj, c2.id AS cat, mod(s.ra + 0.3*t/cos(radians(s.dec)) + 3600, 360) AS ora, s.dec + 0.1*t AS odec, c2.ra AS cra, c2.dec AS cdec FROM s, c2), h AS (SELECT obj, cat, degrees(2*asin(sqrt(least(1.0, pow(sin(radians(cdec-odec)/2),2)+cos(radians(odec))*cos(radians(cdec))*pow(sin(radians(cra-ora)/2),2))))) AS dist FROM o) SELECT obj AS obj_id, cat AS cat_id, round(dist, 6) AS dist FROM h WHERE dist <= 2.0")
def known_moving(spark, d):
    """Rows of a time-tagged catalog where a moving object was at the time of the row."""
    o = _cs(spark, d)[1].withColumn("pm_ra", F.lit(0.3)).withColumn("pm_dec", F.lit(0.1))
    c = _cs(spark, d)[0].join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 1.0).alias("t")), "id")
    return rounded(mv.match_tagged(o, c, 2.0), "dist")


@R.query("flags_from_mask", "WITH m AS (SELECT l_suppkey % 20 AS r, l_partkey % 20 AS c, bit_or(l_linenumber) AS f FROM lineitem GROUP BY 1, 2), s AS (SELECT n_nationkey AS src, n_nationkey % 20 AS sr, n_nationkey*3 % 20 AS sc FROM nation) SELECT src, bit_or(f) AS any_bits, bit_and(f) AS all_bits FROM s JOIN m ON abs(r-sr) <= 1 AND abs(c-sc) <= 1 GROUP BY src")
def flags_from_mask(spark, d):
    """Bits of a mask inside a stamp around each source."""
    from skylattice.operators.imaging import mask_bits

    m = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.bit_or("l_linenumber").alias("f"))
    k = F.col("n_nationkey")
    return mask_bits(m, table(spark, d, "nation").select(k.alias("src"), (k % 20).alias("sr"), (k * 3 % 20).alias("sc")), 1)


@R.query("filter_snr", "WITH p AS (SELECT l_linenumber::BIGINT AS img, l_suppkey % 10 AS r, l_partkey % 10 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), s AS (SELECT img, median(v) AS back, (quantile_cont(v, 0.75)-quantile_cont(v, 0.25))/2*1.4826 AS sd FROM p GROUP BY img), f AS (SELECT a.img, a.r, a.c, sum((b.v-back)*CASE WHEN a.r = b.r AND a.c = b.c THEN 0.5 ELSE 0.0625 END) AS f, any_value(sd) AS sd FROM p a JOIN p b ON a.img = b.img AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 JOIN s ON s.img = a.img GROUP BY a.img, a.r, a.c) SELECT img, r, c, round(f/(sd*sqrt(0.25+8*0.00390625)), 6) AS sn FROM f")
def filter_snr(spark, d):
    """Signal to noise of a point-like template at every pixel."""
    from skylattice.operators.imaging import filter_snr as snr

    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("img"), (F.col("l_suppkey") % 10).alias("r"), (F.col("l_partkey") % 10).alias("c")).agg(F.sum("l_quantity").alias("v"))
    return rounded(snr(p, [[0.0625] * 3, [0.0625, 0.5, 0.0625], [0.0625] * 3]), "sn")


@R.query("unary_variance", "SELECT p_partkey, round(ln(p_retailprice), 9) AS log, round(4.0/(p_retailprice*p_retailprice), 12) AS log_var, round(sqrt(p_retailprice), 9) AS root, round(4.0/(4*p_retailprice), 9) AS root_var FROM part")
def unary_variance(spark, d):
    from skylattice.operators.imaging import propagate_unary

    v = F.col("p_retailprice")
    (a, av), (b, bv) = propagate_unary("log", v, F.lit(4.0)), propagate_unary("sqrt", v, F.lit(4.0))
    return table(spark, d, "part").select("p_partkey", F.round(a, 9).alias("log"), F.round(av, 12).alias("log_var"), F.round(b, 9).alias("root"), F.round(bv, 9).alias("root_var"))


@R.query("find_bin", "SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1200 THEN 1 WHEN p_retailprice < 1500 THEN 2 ELSE 3 END AS bin FROM part")
def find_bin(spark, d):
    """Edges at or below a value."""
    return table(spark, d, "part").select("p_partkey", ca.edges_below(F.col("p_retailprice"), [950.0, 1200.0, 1500.0]).alias("bin"))


@R.query("cone_by_longitude", f"WITH {CS} SELECT id FROM c WHERE degrees(2*asin(sqrt(least(1.0, pow(sin(radians(5.0-dec)/2),2)+cos(radians(dec))*cos(radians(5.0))*pow(sin(radians(1.0-ra)/2),2))))) <= 10.0")
def cone_by_longitude(spark, d):
    """A cone over a catalog kept by longitude: the range of longitudes first, which may wrap."""
    return sp.cone_by_longitude(_cs(spark, d)[0], 1.0, 5.0, 10.0).select("id")


@R.query("select_by_range", f"SELECT id FROM (SELECT p_partkey AS id, p_brand, p_size, {PART} FROM part) WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') OR p_size BETWEEN 5 AND 9")
def select_by_range(spark, d):
    return tb.select_by(table(spark, d, "part"), {"p_brand": ["Brand#11", "Brand#12", "Brand#13"], "p_size": (5, 9)}, every=False).select(F.col("p_partkey").alias("id"))
