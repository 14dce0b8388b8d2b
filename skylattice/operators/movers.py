"""Moving objects: predicted positions, matches along tracks, conjunctions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.sphere import haversine
from skylattice.operators.spatial import each_pair, ids_by_place, zone_pairs

#: Times (16 bytes each) that may be sent to every executor.
SMALL_LIST = 1 << 20
#: Cosines of angles this close may be out of order, as far as their error goes.
ERROR = 1e-12


def predicted(objects: DataFrame, times: DataFrame) -> DataFrame:
    """Position (degrees) of objects (id, ra, dec, pm_ra, pm_dec a unit of time) at every time of a list (t), sent out if it is small."""
    few = times.count() <= SMALL_LIST
    j = objects.crossJoin(F.broadcast(times) if few else times)
    ra = F.pmod(F.col("ra") + F.col("pm_ra") * F.col("t") / F.cos(F.radians("dec")), F.lit(360.0))
    return j.select("id", "t", ra.alias("ra"), (F.col("dec") + F.col("pm_dec") * F.col("t")).alias("dec"))


def match_moving(objects: DataFrame, times: DataFrame, catalog: DataFrame, radius: float) -> DataFrame:
    """Catalog rows (id, ra, dec) within a radius of an object at a time: (obj_id, t, cat_id, dist)."""
    p = predicted(objects, times).select(F.struct(F.col("id").alias("obj"), "t").alias("id"), "ra", "dec")
    return each_pair(zone_pairs(p.withColumn("id", F.array("id")), ids_by_place(catalog, ["ra", "dec"]), radius)).select(F.col("probe_id.obj").alias("obj_id"), F.col("probe_id.t").alias("t"), "cat_id", "dist")


def _flanked(track: DataFrame) -> DataFrame:
    """Rows of moving objects with time and place of the same object before (0) and after (2)."""
    w = Window.partitionBy("id").orderBy("t")
    d = track.where("id is not null and t is not null").select("id", "t", "ra", "dec")
    return d.withColumns({f"{c}{s}": f(c).over(w) for s, f in (("0", F.lag), ("2", F.lead)) for c in ("t", "ra", "dec")})


def _odd(p: DataFrame, q: DataFrame) -> DataFrame:
    """Objects (list, id) that at a time of theirs have other times around it than most, or that time twice."""
    rows = p.select(F.lit(1).alias("list"), "id", "t", F.struct("t0", "t2").alias("s")).unionByName(q.select(F.lit(2).alias("list"), "id", "t", F.struct("t0", "t2").alias("s")))
    most = rows.groupBy("t", "s").agg(F.count("*").alias("n")).groupBy("t").agg(F.max(F.struct("n", "s"))["s"].alias("most"))
    return rows.join(most, "t").where(~F.col("s").eqNullSafe(F.col("most")) | (F.col("s.t0") == F.col("t")) | (F.col("s.t2") == F.col("t"))).select("list", "id").distinct()


def _minima(p: DataFrame, q: DataFrame, min_sep: float) -> DataFrame:
    """Conjunctions of lists whose times before and after are the same: decided where two rows meet.

    The sines and cosines of a distance cost more than the pair, so cosines of
    angles, sums of three products, decide first; where they are closer
    than their error, the distances decide.  Numbers are marked as never null:
    the test of a pair is short enough to be compiled then.
    """

    def vectors(d: DataFrame) -> DataFrame:
        d = d.where(" and ".join(f"{c}{s} is not null" for c in ("t", "ra", "dec") for s in ("", "0", "2")))
        known = lambda c: F.coalesce(c, F.lit(float("nan")))
        for s in ("", "0", "2"):
            ra, dec = F.radians(f"ra{s}"), F.radians(f"dec{s}")
            d = d.withColumns({f"x{s}": known(F.cos(dec) * F.cos(ra)), f"y{s}": known(F.cos(dec) * F.sin(ra)), f"z{s}": known(F.sin(dec))})
        return d

    def cosine(s: str) -> Column:
        return F.col(f"p_x{s}") * F.col(f"c_x{s}") + F.col(f"p_y{s}") * F.col(f"c_y{s}") + F.col(f"p_z{s}") * F.col(f"c_z{s}")

    def far(s: str) -> Column:
        return F.degrees(haversine(F.radians(f"p_ra{s}"), F.radians(f"p_dec{s}"), F.radians(f"c_ra{s}"), F.radians(f"c_dec{s}")))

    least, now, before, after = math.cos(math.radians(min(min_sep, 180.0))), cosine(""), cosine("0"), cosine("2")
    may_be = (now >= least - ERROR) & (before < now + ERROR) & (after < now + ERROR)
    sure = (now >= least + ERROR) & (now <= 1 - ERROR) & (before < now - ERROR) & (after < now - ERROR)
    exact = (F.col("dist") <= min_sep) & (F.col("dist") < F.least(far("0"), far("2")))
    carry = [f"{c}{s}" for s in ("", "0", "2") for c in "xyz"] + ["ra0", "dec0", "ra2", "dec2"]
    m = zone_pairs(vectors(p), vectors(q), min_sep, also=["t"], carry=carry, near=may_be & (sure | exact))
    return m.select(F.col("probe_id").alias("id1"), F.col("cat_id").alias("id2"), "t", "dist")


def _minima_of_pairs(near: DataFrame, p: DataFrame, q: DataFrame, min_sep: float) -> DataFrame:
    """Conjunctions of pairs of objects (id1, id2): their tracks are joined to them, for the distances before and after."""
    x = p.select(F.col("id").alias("id1"), "t", F.radians("ra").alias("r1"), F.radians("dec").alias("d1"))
    y = q.select(F.col("id").alias("id2"), "t", F.radians("ra").alias("r2"), F.radians("dec").alias("d2"))
    d = near.join(x, "id1").join(y, ["id2", "t"]).withColumn("dist", F.degrees(haversine(F.col("r1"), F.col("d1"), F.col("r2"), F.col("d2"))))
    w = Window.partitionBy("id1", "id2").orderBy("t")
    d = d.withColumn("before", F.lag("dist").over(w)).withColumn("after", F.lead("dist").over(w))
    return d.where((F.col("dist") <= min_sep) & (F.col("dist") < F.col("before")) & (F.col("dist") < F.col("after"))).select("id1", "id2", "t", "dist")


def conjunctions(a: DataFrame, b: DataFrame, min_sep: float) -> DataFrame:
    """Local minima of the distance of two moving lists (id, t, ra, dec) at common times, below min_sep degrees.

    Rows carry their object's places before and after, so pairs need not be
    shuffled. Only those of objects whose times are not those of the others
    (looked for by a job first) meet within reach at some time, and then
    have the tracks joined to them.
    """
    p, q = _flanked(a), _flanked(b)
    odd = _odd(p, q)
    if odd.isEmpty():
        return _minima(p, q, min_sep)
    odd1, odd2 = (odd.where(F.col("list") == k).select("id") for k in (1, 2))
    usual1, usual2 = p.join(odd1, "id", "left_anti"), q.join(odd2, "id", "left_anti")
    near = zone_pairs(p.join(odd1, "id", "left_semi"), q, min_sep, also=["t"]).unionByName(zone_pairs(usual1, q.join(odd2, "id", "left_semi"), min_sep, also=["t"]))
    near = near.select(F.col("probe_id").alias("id1"), F.col("cat_id").alias("id2")).distinct()
    return _minima(usual1, usual2, min_sep).unionByName(_minima_of_pairs(near, p, q, min_sep))


def match_tagged(objects: DataFrame, catalog: DataFrame, radius: float) -> DataFrame:
    """Rows of a catalog (id, ra, dec, t) where an object (id, ra, dec, pm_ra, pm_dec) was at their times.

    A track is cut into spans of time in which the object moves a radius at
    most; each span meets the rows of its time in the sky cells around its
    middle, and the position at the time of a row decides.  Objects are put in
    classes of speed, a factor of two each, so that slow ones have few spans;
    their number grows with the length of the tracks, not with the rows.
    """
    span = catalog.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    if span.t0 is None:
        return catalog.limit(0).select(F.col("id").alias("obj_id"), F.col("id").alias("cat_id"), F.lit(0.0).alias("dist"))
    speed = F.hypot(F.col("pm_ra") / F.cos(F.radians("dec")), F.col("pm_dec"))
    # a span so long that none of its objects leaves it needs no longer one
    o = objects.where(speed.isNotNull()).withColumn("__class", F.greatest(F.lit(-30), F.ceil(F.log2(F.greatest(speed / radius, F.lit(1e-12)))).cast("int")))
    classes = [r[0] for r in o.select("__class").distinct().collect()]  # one for each power of two
    length = lambda c: F.pow(F.lit(2.0), -c)
    bucket = lambda t, c: F.floor(t / length(c)).cast("long")
    o = o.withColumn("__bucket", F.explode(F.sequence(bucket(F.lit(float(span.t0)), F.col("__class")), bucket(F.lit(float(span.t1)), F.col("__class")))))
    mid = (F.col("__bucket") + 0.5) * length(F.col("__class"))
    ra = lambda o, t: F.pmod(o["ra"] + o["pm_ra"] * t / F.cos(F.radians(o["dec"])), F.lit(360.0))
    dec = lambda o, t: o["dec"] + o["pm_dec"] * t
    track = F.struct("id", "ra", "dec", "pm_ra", "pm_dec")
    p = o.select("__class", "__bucket", track.alias("id"), ra(track, mid).alias("ra"), dec(track, mid).alias("dec"))
    c = catalog.where("t is not null").withColumn("__class", F.explode(F.array(*[F.lit(x) for x in classes]).cast("array<int>")))
    c = c.select("__class", bucket(F.col("t"), F.col("__class")).alias("__bucket"), F.struct("id", "ra", "dec", "t").alias("id"), "ra", "dec")
    near = zone_pairs(p, c, 1.6 * radius, also=["__class", "__bucket"])
    a, b = F.col("probe_id"), F.col("cat_id")
    dist = F.degrees(haversine(F.radians(ra(a, b["t"])), F.radians(dec(a, b["t"])), F.radians(b["ra"]), F.radians(b["dec"])))
    return near.select(a["id"].alias("obj_id"), b["id"].alias("cat_id"), dist.alias("dist")).where(F.col("dist") <= radius)
