"""Selections, bins and statistics of matched catalogs and light curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import largest_group, own, quantiles, row_windows, running
from skylattice.operators.spatial import plane_place_pairs
from skylattice.operators.stats import IQR_TO_STD, half_open_bin


def design_matrix(df: DataFrame, key: str, terms: Sequence[Column], y: str) -> DataFrame:
    """Columns h0, h1, .. of the terms and y."""
    return df.select(key, *[t.alias(f"h{i}") for i, t in enumerate(terms)], F.col(y).alias("y"))


def indicator_design(df: DataFrame, key: str, source: str, epoch: str) -> DataFrame:
    """Sparse design matrix of mag = zp(epoch) + mean(source): (key, name of the column, 1) for both unknowns of every row."""
    names = F.array(F.concat(F.lit("zp_"), F.col(epoch).cast("string")), F.concat(F.lit("mean_"), F.col(source).cast("string")))
    return df.select(key, F.explode(names).alias("column")).withColumn("h", F.lit(1.0))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean and extremes of columns, one row each, in one pass."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))])
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"), F.col(f"lo_{c}").cast("double").alias("lo"), F.col(f"hi_{c}").cast("double").alias("hi")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_key(df: DataFrame, name: str, key: Column) -> DataFrame:
    """A generated key for inserted rows."""
    return df.withColumn(name, key)


def to_array(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias("values"))


def from_array(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])


def residuals(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Offsets of nearest planar matches: count, means, deviation."""
    near = plane_place_pairs(a, b, radius).groupBy("p").agg(F.min_by("q", F.struct("dist", "q.lo")).alias("q"))
    # points of one place have one partner, so the moments of places are added with the number of their points
    j = near.select(F.col("p.n").alias("n"), (F.col("q.x") - F.col("p.x")).alias("dx"), (F.col("q.y") - F.col("p.y")).alias("dy"))
    m = j.groupBy("dx").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dy")).alias("sy"))
    mean = m.agg(F.sum("n").alias("k"), F.try_divide(F.sum(F.col("n") * F.col("dx")), F.sum("n")).alias("mx"), F.try_divide(F.sum("sy"), F.sum("n")).alias("my"))
    off = F.col("dx") - F.col("mx")
    s = m.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * off * off).alias("ss"))
    return mean.crossJoin(F.broadcast(s)).select(F.coalesce("k", F.lit(0)).alias("n"), F.col("mx").alias("mean_dx"), F.col("my").alias("mean_dy"), F.sqrt(F.try_divide("ss", F.nullif(F.col("k") - 1, F.lit(0)))).alias("std_dx"))


def sky_tile(ra: Column, dec: Column, size: float) -> tuple[Column, Column]:
    """Row of declination and tile along it (degrees); a row has tiles of about equal area."""
    row = F.floor((dec + 90) / size)
    count = F.greatest(F.lit(1), F.floor(360 / size * F.cos(F.radians(F.abs(row * size - 90 + size / 2)))))
    return row.cast("bigint"), F.floor(ra / (360.0 / count)).cast("bigint")


def overlaps(a: DataFrame, b: DataFrame, ka: str, kb: str, bucket: float) -> DataFrame:
    """Pairs of inclusive intervals (k_lo, k_hi) that overlap; met in buckets, each pair once."""

    def cut(d: DataFrame, k: str) -> DataFrame:
        return d.withColumn("__b", F.explode(F.sequence(F.floor(F.col(f"{k}_lo") / bucket), F.floor(F.col(f"{k}_hi") / bucket))))

    j = cut(a, ka).join(cut(b, kb), "__b").where((F.col(f"{ka}_lo") <= F.col(f"{kb}_hi")) & (F.col(f"{kb}_lo") <= F.col(f"{ka}_hi")))
    first = F.floor(F.greatest(F.col(f"{ka}_lo"), F.col(f"{kb}_lo")) / bucket)
    return j.where(F.col("__b") == first).select(ka, kb)


def dilute(df: DataFrame, mag: str, density: float, target: float) -> DataFrame:
    """The brightest rows, so that the density falls to the target; missing magnitudes are dropped."""
    if density <= target:
        return df.where(F.col(mag).isNotNull())
    limit = df.agg(F.percentile(mag, F.lit(target / density)).alias("__q"))
    return df.join(F.broadcast(limit)).where(F.col(mag) < F.col("__q")).drop("__q")


def strict_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], every: bool = True) -> DataFrame:
    flags = [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in ranges.items()]
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), flags))


def mode_density(df: DataFrame, value: str, by: Sequence[str], k: int) -> DataFrame:
    """Middle of the shortest stretch of k + 1 sorted values."""
    d, w = row_windows(df.select(*by, value), by, [value], 0, k)
    d = own(d.withColumn("__up", F.lead(value, k).over(w))).where("__up is not null")
    return d.groupBy(*by).agg(F.min_by((F.col(value) + F.col("__up")) / 2, F.struct(F.col("__up") - F.col(value), F.col(value))).alias("mode"))


def all_cuts(df: DataFrame, axes: Sequence[str], agg: Column) -> DataFrame:
    """An aggregate over every pair of axes, in one pass."""
    return df.groupingSets([[F.col(a), F.col(b)] for a, b in combinations(axes, 2)], *axes).agg(agg)


def histogram(df: DataFrame, value: str, lo: float, hi: float, step: float) -> DataFrame:
    """Counts in (lo, hi] bins and their shares; the shares come from the bins, not from a second pass."""
    b = half_open_bin(F.col(value), lo, step)
    c = df.where((F.col(value) > lo) & (F.col(value) <= hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("__t")))).select("bin", "n", (F.col("n") / F.col("__t")).alias("share"))


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based number of the (lo, hi] range between edges, null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False), 1):
        out = F.when((value > lo) & (value <= hi), F.lit(i)).otherwise(out)
    return out


def kernel_mean(df: DataFrame, key: str, t: str, value: str, by: Sequence[str], width: float) -> DataFrame:
    """Triangular-kernel mean around every row; rows meet through time buckets of one width."""
    a = df.select(*by, key, F.col(t).alias("ta"), F.explode(F.array(*[F.floor(F.col(t) / width) + i for i in (-1, 0, 1)])).alias("__b"))
    b = df.select(*by, F.col(t).alias("tb"), F.col(value).alias("v"), F.floor(F.col(t) / width).alias("__b"))
    j = a.join(b, [*by, "__b"]).withColumn("w", 1 - F.abs(F.col("tb") - F.col("ta")) / width).where("w > 0")
    return j.groupBy(key).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("smooth"))


def integral_limits(df: DataFrame, t: str, value: str, by: Sequence[str], share: float, order: Sequence[str] = ()) -> DataFrame:
    """Times at which the running sum passes the tails outside a central share."""
    d = running(df, by, [t, *order], value, "__s", "__t").withColumn("__c", F.col("__s") / F.col("__t"))
    tail = round((1 - share) / 2, 12)
    return d.groupBy(*by).agg(F.min(F.when(F.col("__c") >= tail, F.col(t))).alias("left_limit"), F.min(F.when(F.col("__c") >= 1 - tail, F.col(t))).alias("right_limit"))


def trapezoid_error(df: DataFrame, t: str, err: str, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Error of the trapezoid integral from independent errors."""
    d, w = row_windows(df, by, [t, *order], 0, 1)
    e = F.lead(err).over(w)
    d = own(d.withColumn("__s", F.pow((F.lead(t).over(w) - F.col(t)) / 2, F.lit(2)) * (F.col(err) * F.col(err) + e * e)))
    return d.groupBy(*by).agg(F.sqrt(F.coalesce(F.sum("__s"), F.lit(0.0))).alias("int_err"))


def clip_by(df: DataFrame, columns: Sequence[str], by: Sequence[str], sigma: float) -> DataFrame:
    """Rows within sigma deviations in every further column."""
    s = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    ok = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"__m_{c}")) <= sigma * F.col(f"__s_{c}") for c in columns])
    return df.join(s, list(by)).where(ok).select(*df.columns)


def residual_outliers(df: DataFrame, source: str, mag: str, step: float, sigma: float) -> DataFrame:
    """Flag of residuals (from the source mean) far from the median of their magnitude bin, in robust deviations."""
    m = df.groupBy(source).agg(F.avg(mag).alias("__a"))
    d = df.join(m, source).withColumn("__r", F.col(mag) - F.col("__a")).withColumn("__b", F.ceil(F.col(mag) / step))
    # bins are few, so each holds a large part of all rows
    q = quantiles(d, ["__b"], "__r", {"__lo": 0.25, "__med": 0.5, "__hi": 0.75})
    s = q.select("__b", "__med", ((F.col("__hi") - F.col("__lo")) / 2 * IQR_TO_STD).alias("__sd"))
    return d.join(s, "__b").withColumn("outlier", F.abs(F.col("__r") - F.col("__med")) > sigma * F.greatest(F.col("__sd"), F.lit(0.001)))


def robust_zero_point(df: DataFrame, diff: str, by: Sequence[str], sigma: float) -> DataFrame:
    """Median, error of the mean and count of differences within sigma robust deviations of their median."""
    large = largest_group(df, by)
    q = quantiles(df, by, diff, {"__lo": 0.25, "__m": 0.5, "__hi": 0.75}, large)
    c = q.select(*by, "__m", ((F.col("__hi") - F.col("__lo")) / 2 * IQR_TO_STD).alias("__s"))
    good = df.join(c, list(by)).where(F.abs(F.col(diff) - F.col("__m")) <= sigma * F.col("__s"))
    mid = quantiles(good, by, diff, {"zp": 0.5}, large).drop("__n")
    return mid.join(good.groupBy(*by).agg((F.coalesce(F.stddev_samp(diff), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("zp_err"), F.count("*").alias("n")), list(by))


def edges_below(value: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are at or below a value."""
    return reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges])
