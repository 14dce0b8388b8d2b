"""Ordered operators: runs, gaps, running statistics, interpolation, as-of joins.

All windows are partitioned by a series key; an operator over one global
series takes a bucket key or pre-aggregates first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import own, row_windows


def counter_runs(df: DataFrame, counter: str, by: Sequence[str], min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """Runs of counters that go up by one; long ones are cut at max_size, short ones dropped."""
    w = Window.partitionBy(*by).orderBy(counter)
    d = df.select(*by, counter).distinct().withColumn("g", F.col(counter) - F.row_number().over(w))
    d = d.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*by, "g").orderBy(counter)) - 1) / max_size) if max_size else F.lit(0))
    return d.groupBy(*by, "g", "part").agg(F.min(counter).alias("first_c"), F.max(counter).alias("last_c"), F.count("*").alias("n")).where(F.col("n") >= min_size).drop("g", "part")


def time_gap_groups(df: DataFrame, t: str, by: Sequence[str], gap: float, min_size: int = 1, id_col: str | None = None) -> DataFrame:
    """Groups of rows without a step over ``gap`` (in the unit of t)."""
    w = Window.partitionBy(*by).orderBy(t, *([id_col] if id_col else []))
    d = df.withColumn("new", F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0)))
    d = d.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "grp").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n")).where(F.col("n") >= min_size)


def flag_regions(df: DataFrame, pos: str, flag: Column, by: Sequence[str]) -> DataFrame:
    """First and last position of every run of true flags; positions are consecutive integers."""
    d = df.where(flag).withColumn("g", F.col(pos) - F.row_number().over(Window.partitionBy(*by).orderBy(pos)))
    return d.groupBy(*by, "g").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos")).drop("g")


def running_mean(value: str, half: int, w: Window) -> Column:
    """Box mean of 2 half + 1 rows whose divisor stays the same at the edges."""
    return F.sum(value).over(w.rowsBetween(-half, half)) / (2 * half + 1)


def running_median(value: str, around: Window) -> Column:
    """Median of the rows of a short frame: the middle of their sorted list."""
    v = F.array_sort(F.collect_list(value).over(around))
    n = F.size(v)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def running_z(value: str, half: int, w: Window) -> Column:
    """Value minus the mean of the rows around it, in their deviations."""
    around = w.rowsBetween(-half, half)
    return F.try_divide(F.col(value) - F.avg(value).over(around), F.stddev_samp(value).over(around))


def von_neumann(df: DataFrame, t: str, value: str, by: Sequence[str]) -> DataFrame:
    """n sum(step^2) / ((n-1) sum(deviation^2)) per series; NULL for constant or single values."""
    d, w = row_windows(df, by, t.split(","), 1, 0)
    d = own(d.withColumn("step", F.col(value) - F.lag(value).over(w)))
    a = d.groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.col("step") * F.col("step")).alias("ss"), F.var_samp(value).alias("v"))
    return a.select(*by, F.when(F.col("v") > 0, F.col("n") * F.col("ss") / ((F.col("n") - 1) * F.col("v") * (F.col("n") - 1))).alias("von_neumann"))


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Integral by the trapezoid rule."""
    d, w = row_windows(df, by, [x, *order], 0, 1)
    d = own(d.withColumn("a", F.abs(F.lead(x).over(w) - F.col(x)) * (F.col(y) + F.lead(y).over(w)) / 2))
    return d.groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("integral"))


def curve_length(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Length of the line through the points."""
    d, w = row_windows(df, by, [x, *order], 1, 0)
    d = own(d.withColumn("dx", F.col(x) - F.lag(x).over(w)).withColumn("dy", F.col(y) - F.lag(y).over(w)))
    return d.groupBy(*by).agg(F.coalesce(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.lit(0.0)).alias("length"))


def local_extrema(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rows higher or lower than both neighbours, with the vertex of the parabola through the three."""
    d, w = row_windows(df, by, [x], 1, 1)
    d = own(d.withColumn("y0", F.lag(y).over(w)).withColumn("y2", F.lead(y).over(w)).withColumn("x0", F.lag(x).over(w)).withColumn("x2", F.lead(x).over(w)))
    kind = F.when((F.col(y) > F.col("y0")) & (F.col(y) > F.col("y2")), "max").when((F.col(y) < F.col("y0")) & (F.col(y) < F.col("y2")), "min")
    d = d.withColumn("kind", kind).where("kind is not null")
    a, b = F.col(x) - F.col("x0"), F.col(x) - F.col("x2")
    fa, fb = F.col(y) - F.col("y2"), F.col(y) - F.col("y0")
    return d.select(*by, x, y, "kind", (F.col(x) - 0.5 * F.try_divide(a * a * fa - b * b * fb, a * fa - b * fb)).alias("vertex"))


def zero_crossings(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Linear roots between rows of opposite sign."""
    d, w = row_windows(df, by, [x], 1, 0)
    d = own(d.withColumn("x0", F.lag(x).over(w)).withColumn("y0", F.lag(y).over(w))).where(F.col("y0") * F.col(y) < 0)
    return d.select(*by, (F.col("x0") - F.col("y0") * (F.col(x) - F.col("x0")) / (F.col(y) - F.col("y0"))).alias("root"))


def continuous_longitude(lon: str, w: Window) -> Column:
    """Longitudes (radians) of a series that lies across the origin, made continuous."""
    quarter, turn = 1.5707963267948966, 6.283185307179586
    across = (F.min(lon).over(w) < quarter) & (F.max(lon).over(w) > 3 * quarter)
    up = F.avg(lon).over(w) > 2 * quarter
    v = F.col(lon)
    return F.when(across & up & (v < 2 * quarter), v + turn).when(across & ~up & (v > 2 * quarter), v - turn).otherwise(v)


def fill_linear(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Missing y by linear interpolation in x; ends without a neighbour stay missing."""
    w = Window.partitionBy(*by).orderBy(x)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    d = df.withColumn("a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.when(F.col("b.x").isNotNull(), F.col("a.y") + F.coalesce(F.try_divide((F.col("b.y") - F.col("a.y")) * (F.col(x) - F.col("a.x")), F.col("b.x") - F.col("a.x")), F.lit(0.0)))
    return d.withColumn("filled", F.coalesce(y, line)).drop("a", "b")


def interpolate_at(df: DataFrame, grid: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Linear interpolation of each series at the positions of ``grid`` (same columns ``by`` and x): both are merged in order and the gaps filled."""
    both = df.select(*by, x, F.col(y).cast("double").alias(y), F.lit(False).alias("is_grid")).unionByName(grid.select(*by, x, F.lit(None).cast("double").alias(y), F.lit(True).alias("is_grid")))
    return fill_linear(both, x, y, by).where("is_grid").select(*by, x, F.col("filled").alias(y))


def asof(left: DataFrame, right: DataFrame, t: str, by: Sequence[str], value: str) -> DataFrame:
    """For each left row the last right value at or before its time: one union and one window, no range join."""
    cols = left.columns
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*[F.col(c) if c in (*by, t) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(*by).orderBy(t, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__v", True).over(w)).where("__side = 1").drop("__side", "__v")


def interval_join(points: DataFrame, intervals: DataFrame, t: str, lo: str, hi: str, bucket: float) -> DataFrame:
    """Points inside inclusive intervals; both get a bucket of time, so that it is an equi-join with a residual."""
    p = points.withColumn("__b", F.floor(F.col(t) / bucket))
    i = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    return p.join(i, "__b").where(F.col(t).between(F.col(lo), F.col(hi))).drop("__b")


def nearest_value(left: DataFrame, right: DataFrame, x: str, bucket: float) -> DataFrame:
    """For each left row (id, x) the right row (key, x) of the nearest value: the one below and the one above are looked up in order.

    Rows are numbered by range: the last value of every bucket before and the
    first of every bucket after are found over the buckets that hold any, so
    windows are within a bucket and over the buckets, never over all rows.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    best = right.groupBy(x).agg(F.min("key").alias("key")).withColumn("__b", b(x))
    at = F.struct(F.col(x).alias("x"), F.col("key").alias("key"))
    both = left.select("id", x, F.lit(1).alias("side"), F.lit(None).cast(right.schema["key"].dataType).alias("key"), b(x).alias("__b")).unionByName(best.select(F.lit(None).cast(left.schema["id"].dataType).alias("id"), x, F.lit(0).alias("side"), "key", "__b"))
    known = F.when(F.col("side") == 0, at)
    # a frame that ends with its group is summed anew for every row: the first one after is the last one of the way back
    w, back = Window.partitionBy("__b").orderBy(x, "side"), Window.partitionBy("__b").orderBy(F.desc(x), F.desc("side"))
    d = both.withColumn("lo", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ends = both.groupBy("__b").agg(F.max(known).alias("top"), F.min(known).alias("bottom"))
    over = Window.orderBy("__b")  # one row a bucket that holds any
    ends = ends.select("__b", F.last("top", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("bottom", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    d = d.where("side = 1").join(ends, "__b").withColumn("lo", F.coalesce("lo", "before")).withColumn("hi", F.coalesce("hi", "after"))
    above = F.col("lo").isNull() | (F.col("hi.x") - F.col(x) < F.col(x) - F.col("lo.x"))
    return d.select("id", x, F.when(above, F.col("hi.key")).otherwise(F.col("lo.key")).alias("key"))
