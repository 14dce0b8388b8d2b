"""Directions and times from term tables: nutation, the Earth about the barycentre, tabulated clock offsets.

Every row is computed by itself, so nothing is shuffled but the rows that
:func:`from_table` looks up in a table of times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.solar import AU_SECONDS, J2000
from skylattice.functions.sphere import from_unit_vector, unit_vector
from skylattice.operators.groups import ranked

#: Terms of the IAU 1980 nutation from 0.0003 arcseconds up.  Multiples of the Moon's elongation,
#: the Sun's and the Moon's anomaly, the Moon's argument of latitude and its node; then the sine in longitude and
#: the cosine in obliquity, each with its change a century (0.0001 arcseconds).
NUTATION = """
 0  0  0  0  1  -171996 -174.2  92025  8.9
-2  0  0  2  2   -13187   -1.6   5736 -3.1
 0  0  0  2  2    -2274   -0.2    977 -0.5
 0  0  0  0  2     2062    0.2   -895  0.5
 0  1  0  0  0     1426   -3.4     54 -0.1
 0  0  1  0  0      712    0.1     -7    0
-2  1  0  2  2     -517    1.2    224 -0.6
 0  0  0  2  1     -386   -0.4    200    0
 0  0  1  2  2     -301      0    129 -0.1
-2 -1  0  2  2      217   -0.5    -95  0.3
-2  0  1  0  0     -158      0      0    0
-2  0  0  2  1      129    0.1    -70    0
 0  0 -1  2  2      123      0    -53    0
 2  0  0  0  0       63      0      0    0
 0  0  1  0  1       63    0.1    -33    0
 2  0 -1  2  2      -59      0     26    0
 0  0 -1  0  1      -58   -0.1     32    0
 0  0  1  2  1      -51      0     27    0
-2  0  2  0  0       48      0      0    0
 0  0 -2  2  1       46      0    -24    0
 2  0  0  2  2      -38      0     16    0
 0  0  2  2  2      -31      0     13    0
 0  0  2  0  0       29      0      0    0
-2  0  1  2  2       29      0    -12    0
 0  0  0  2  0       26      0      0    0
-2  0  0  2  0      -22      0      0    0
 0  0 -1  2  1       21      0    -10    0
 0  2  0  0  0       17   -0.1      0    0
 2  0 -1  0  1       16      0     -8    0
-2  2  0  2  2      -16    0.1      7    0
 0  1  0  0  1      -15      0      9    0
-2  0  1  0  1      -13      0      7    0
 0 -1  0  0  1      -12      0      6    0
 0  0  2 -2  0       11      0      0    0
 2  0 -1  2  1      -10      0      5    0
 2  0  1  2  2       -8      0      3    0
 0  1  0  2  2        7      0     -3    0
-2  1  1  0  0       -7      0      0    0
 0 -1  0  2  2       -7      0      3    0
 2  0  0  2  1       -7      0      3    0
 2  0  1  0  0        6      0      0    0
-2  0  2  2  2        6      0     -3    0
-2  0  1  2  1        6      0     -3    0
 2  0 -2  0  1       -6      0      3    0
 2  0  0  0  1       -6      0      3    0
 0 -1  1  0  0        5      0      0    0
-2 -1  0  2  1       -5      0      3    0
-2  0  0  0  1       -5      0      3    0
 0  0  2  2  1       -5      0      3    0
-2  0  2  0  1        4      0      0    0
-2  1  0  2  1        4      0      0    0
 0  0  1 -2  0        4      0      0    0
-1  0  1  0  0       -4      0      0    0
-2  1  0  0  0       -4      0      0    0
 1  0  0  0  0       -4      0      0    0
 0  0  1  2  0        3      0      0    0
 0  0 -2  2  2       -3      0      0    0
-1 -1  1  0  0       -3      0      0    0
 0  1  1  0  0       -3      0      0    0
 0 -1  1  2  2       -3      0      0    0
 2 -1 -1  2  2       -3      0      0    0
 0  0  3  2  2       -3      0      0    0
 2 -1  0  2  2       -3      0      0    0
"""
#: The five arguments in degrees, by powers of the time in centuries.
ARGUMENTS = ((297.85036, 445267.111480, -0.0019142, 1 / 189474), (357.52772, 35999.050340, -0.0001603, -1 / 300000), (134.96298, 477198.867398, 0.0086972, 1 / 56250), (93.27191, 483202.017538, -0.0036825, 1 / 327270), (125.04452, -1934.136261, 0.0020708, 1 / 450000))
#: Mean obliquity in arcseconds, by powers of the time in centuries.
OBLIQUITY = (84381.448, -46.8150, -0.00059, 0.001813)
#: Mean orbits for 1800-2050 in the ecliptic of J2000 with their changes a century.  Semi-major axis
#: (astronomical units), eccentricity, inclination, mean longitude, longitude of perihelion, node (degrees); last
#: the mass of the Sun in that of the planet.  The third is the Earth with the Moon.
PLANETS = """
 0.38709927  0.00000037 0.20563593  0.00001906  7.00497902 -0.00594749 252.25032350 149472.67411175  77.45779628  0.16047689  48.33076593 -0.12534081 6023600
 0.72333566  0.00000390 0.00677672 -0.00004107  3.39467605 -0.00078890 181.97909950  58517.81538729 131.60246718  0.00268329  76.67984255 -0.27769418 408523.71
 1.00000261  0.00000562 0.01671123 -0.00004392 -0.00001531 -0.01294668 100.46457166  35999.37244981 102.93768193  0.32327364   0.0          0.0        328900.56
 1.52371034  0.00001847 0.09339410  0.00007882  1.84969142 -0.00813131  -4.55343205  19140.30268499 -23.94362959  0.44441088  49.55953891 -0.29257343 3098708
 5.20288700 -0.00011607 0.04838624 -0.00013253  1.30439695 -0.00183714  34.39644051   3034.74612775  14.72847983  0.21252668 100.47390909  0.20469106 1047.3486
 9.53667594 -0.00125060 0.05386179 -0.00050991  2.48599187  0.00193609  49.95424423   1222.49362201  92.59887831 -0.41897216 113.66242448 -0.28867794 3497.898
19.18916464 -0.00196176 0.04725744 -0.00004397  0.77263783 -0.00242939 313.23810451    428.48202785 170.95427630  0.40805281  74.01692503  0.04240589 22902.98
30.06992276  0.00026291 0.00859048  0.00005105  1.77004347  0.00035372 -55.12002969    218.45945325  44.96476227 -0.32241464 131.78422574 -0.00508664 19412.24
"""
#: Obliquity of J2000 (degrees), distance of the Earth's centre from that of the Earth and the Moon.
TILT, EARTH_OFFSET = 23.43928, 3.122e-5
#: Newton steps of Kepler's equation: for these eccentricities the fourth is at rounding.
STEPS = 5
#: Times of a table that may be broadcast (some 6 MB), and the tasks among which the rows of a bucket are dealt otherwise.
FEW, DEALS = 100_000, 16


def rows_of(text: str) -> list[list[float]]:
    """Numbers of a term table."""
    return [[float(x) for x in line.split()] for line in text.strip().splitlines()]


def polynomial(t: Column, factors) -> Column:
    """Sum of factors times powers of t."""
    return reduce(lambda a, f: a * t + f, reversed(factors[:-1]), F.lit(float(factors[-1])))


def nutation(df: DataFrame, jd: str, psi: str = "psi", eps: str = "eps", tilt: str = "tilt") -> DataFrame:
    """Rows with the nutation in longitude and obliquity and the mean obliquity at a Julian day, in radians (null for a null day)."""
    t = (F.col(jd) - J2000) / 36525
    d = df.withColumns({f"__n{i}": F.radians(polynomial(t, a)) for i, a in enumerate(ARGUMENTS)})
    lon, tip = [], []
    for *k, s, s1, c, c1 in rows_of(NUTATION):
        angle = sum(F.col(f"__n{i}") * m for i, m in enumerate(k) if m)
        lon.append(F.sin(angle) * (s + s1 * t if s1 else s))
        if c:
            tip.append(F.cos(angle) * (c + c1 * t if c1 else c))
    d = d.withColumns({psi: F.radians(sum(lon) / 3.6e7), eps: F.radians(sum(tip) / 3.6e7), tilt: F.radians(polynomial(t, OBLIQUITY) / 3600)})
    return d.drop(*[f"__n{i}" for i in range(5)])


def turned_x(v: tuple, angle: Column) -> tuple:
    """Vector in axes turned about the first one."""
    return v[0], v[1] * F.cos(angle) + v[2] * F.sin(angle), v[2] * F.cos(angle) - v[1] * F.sin(angle)


def turned_z(v: tuple, angle: Column) -> tuple:
    """Vector in axes turned about the third one."""
    return v[0] * F.cos(angle) + v[1] * F.sin(angle), v[1] * F.cos(angle) - v[0] * F.sin(angle), v[2]


def true_of_date(df: DataFrame, jd: str, lon: str, lat: str, out_lon: str, out_lat: str) -> DataFrame:
    """Directions (radians) of the mean equator of their date referred to the true one, by the whole rotation."""
    d = nutation(df, jd, "__psi", "__eps", "__tilt")
    v = turned_x(unit_vector(F.col(lon), F.col(lat)), F.col("__tilt"))
    v = dict(zip(("__x", "__y", "__z"), turned_x(turned_z(v, -F.col("__psi")), -F.col("__tilt") - F.col("__eps")), strict=True))
    lo, la = from_unit_vector(*[F.col(c) for c in v])
    return d.withColumns(v).withColumns({out_lon: lo, out_lat: la}).drop("__psi", "__eps", "__tilt", *v)


def _bodies() -> Column:
    names = ("a", "a1", "e", "e1", "i", "i1", "l", "l1", "p", "p1", "o", "o1", "mass")
    total = sum(1 / r[-1] for r in rows_of(PLANETS))
    parts = []
    for k, r in enumerate(rows_of(PLANETS)):
        # the Sun moves against every planet by its share of the mass; the Earth has its own place besides
        share = -1 / r[-1] / (1 + total) + (k == 2)
        parts.append(F.struct(*[F.lit(x).alias(n) for n, x in zip(names[:-1], r, strict=False)], F.lit(share).alias("share")))
    return F.array(*parts)


def _eccentric(m: Column, e: Column) -> Column:
    step = lambda x, _: x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x))
    return F.aggregate(F.array_repeat(F.lit(0), STEPS), m + e * F.sin(m), step)


def earth(df: DataFrame, jd: str, name: str = "earth") -> DataFrame:
    """Rows with the Earth's place (x y z, astronomical units) and motion (vx vy vz, a day) about the barycentre as a struct.

    Equatorial axes of J2000, from mean orbits of the planets: good to about
    2e-4 units, a tenth of a second of light time, between 1800 and 2050.
    A null day gives nulls.
    """
    t = (F.col(jd) - J2000) / 36525

    def orbit(b: Column) -> Column:
        a, e = b["a"] + b["a1"] * t, b["e"] + b["e1"] * t
        i, o = F.radians(b["i"] + b["i1"] * t), F.radians(b["o"] + b["o1"] * t)
        p = F.radians(b["p"] + b["p1"] * t)
        m = F.radians(F.pmod(b["l"] + b["l1"] * t - b["p"] - b["p1"] * t, F.lit(360.0)))
        return F.struct(a.alias("a"), e.alias("e"), i.alias("i"), o.alias("o"), (p - o).alias("w"), _eccentric(m, e).alias("x"), F.radians((b["l1"] - b["p1"]) / 36525).alias("rate"), b["share"].alias("share"))

    def moved(s: Column, b: Column) -> Column:
        flat = F.sqrt(1 - b["e"] * b["e"])
        speed = b["a"] * b["rate"] / (1 - b["e"] * F.cos(b["x"]))
        place = (b["a"] * (F.cos(b["x"]) - b["e"]), b["a"] * flat * F.sin(b["x"]), F.lit(0.0))
        motion = (-speed * F.sin(b["x"]), speed * flat * F.cos(b["x"]), F.lit(0.0))
        turn = lambda v: turned_z(turned_x(turned_z(v, -b["w"]), -b["i"]), -b["o"])
        return F.struct(*[(s[c] + b["share"] * x).alias(c) for c, x in zip(("x", "y", "z", "vx", "vy", "vz"), (*turn(place), *turn(motion)), strict=True)])

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])
    d = df.withColumn("__orbits", F.transform(_bodies(), orbit)).withColumn("__sum", F.aggregate("__orbits", zero, moved))
    moon, rate = F.radians(218.3165 + 481267.8813 * t + 6.289 * F.sin(F.radians(134.963 + 477198.8676 * t))), 0.2299715
    s = F.col("__sum")
    place = turned_x((s["x"] - EARTH_OFFSET * F.cos(moon), s["y"] - EARTH_OFFSET * F.sin(moon), s["z"]), -F.radians(F.lit(TILT)))
    motion = turned_x((s["vx"] + EARTH_OFFSET * rate * F.sin(moon), s["vy"] - EARTH_OFFSET * rate * F.cos(moon), s["vz"]), -F.radians(F.lit(TILT)))
    cols = [x.alias(c) for c, x in zip(("x", "y", "z", "vx", "vy", "vz"), (*place, *motion), strict=True)]
    return d.withColumn(name, F.when(F.col(jd).isNotNull(), F.struct(*cols))).drop("__orbits", "__sum")


def barycentric(df: DataFrame, jd: str, lon: str, lat: str, delay: str = "delay", velocity: str = "velocity") -> DataFrame:
    """Rows with the seconds from the light's arrival at the Earth to that at the barycentre, and the Earth's speed towards the direction (km/s)."""
    u = unit_vector(F.col(lon), F.col(lat))
    along = lambda names: sum(F.col("__earth")[c] * x for c, x in zip(names, u, strict=True))
    d = earth(df, jd, "__earth")
    return d.withColumns({delay: along(("x", "y", "z")) * AU_SECONDS, velocity: along(("vx", "vy", "vz")) * (149597870.7 / 86400)}).drop("__earth")


def from_table(df: DataFrame, t: str, known: DataFrame, at: str, value: str, step: float, name: str) -> DataFrame:
    """Rows with a value between both neighbours of their time in a table (linear), such as UT1 - UTC by day.

    Intervals between successive times of the table meet the rows through time
    buckets of ``step`` (about the table's spacing): a broadcast where the table,
    which is counted, has at most FEW times, an equi-join with dealt out rows
    beyond.  Equal times of the table count with their mean; at a time of the
    table its value is returned.  Null outside the table and for a null time.
    """
    k = known.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(at).cast("double").alias("__a")).agg(F.avg(value).alias("__u"))
    few = k.count() <= FEW
    k = ranked(k, [], ["__a"], "__i", "__n").select("__a", "__u", "__i")
    nxt = k.select((F.col("__i") - 1).alias("__i"), F.col("__a").alias("__b"), F.col("__u").alias("__v"))
    bucket = lambda c: F.floor(c / step)
    # an interval holds its start; the last time of the table is an interval of its own
    j = k.join(nxt, "__i", "left").select("__a", "__u", F.coalesce("__b", "__a").alias("__b"), F.coalesce("__v", "__u").alias("__v"), F.col("__b").isNull().alias("__end"))
    j = j.withColumn("__k", F.explode(F.sequence(bucket(F.col("__a")), bucket(F.col("__b")))))
    same = (F.col("__q") == F.col("__k")) & (F.col("__t") >= F.col("__a")) & ((F.col("__t") < F.col("__b")) | F.col("__end") & (F.col("__t") == F.col("__a")))
    rows = df.withColumn("__t", F.col(t).cast("double")).withColumn("__q", bucket(F.col("__t")))
    if few:
        j = F.broadcast(j)
    else:
        # many rows may share a bucket: they are dealt out by their place in their partition
        rows = rows.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEALS)))
        j = j.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        same = same & (F.col("__deal") == F.col("__to"))
    out = rows.join(j, same, "left")
    share = F.coalesce(F.try_divide(F.col("__t") - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))
    return out.withColumn(name, F.col("__u") + share * (F.col("__v") - F.col("__u"))).drop("__t", "__q", "__k", "__a", "__u", "__b", "__v", "__end", "__deal", "__to")
