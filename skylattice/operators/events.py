"""Event lists: bad-time detection, energy cuts, images, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bad_times(events: DataFrame, t: str, min_bin: float = 30.0, n_sigma: float = 4.0) -> DataFrame:
    """Bad [lo, hi] bins: equal bins of max(min_bin, 100 range / n) whose count is over median + n_sigma sqrt(median).

    Empty bins count as 0; a trailing part of a bin is none.  Only the counts
    of bins are gathered, events are combined before the shuffle.
    """
    r = events.agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(t).alias("n"))
    r = r.select("t0", F.greatest(F.lit(min_bin), F.try_divide(100 * (F.col("t1") - F.col("t0")), F.col("n"))).alias("step"), "t1").withColumn("bins", F.floor((F.col("t1") - F.col("t0")) / F.col("step")).cast("bigint"))
    e = events.select(t).join(F.broadcast(r)).withColumn("bin", F.floor((F.col(t) - F.col("t0")) / F.col("step")).cast("bigint"))
    c = e.where("bin < bins").groupBy("bin").agg(F.count("*").alias("c"))
    every = r.where("bins > 0").select("t0", "step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    full = every.join(c, "bin", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    m = full.agg(F.median("c").alias("med"))
    return full.join(F.broadcast(m)).where(F.col("c") > F.col("med") + n_sigma * F.sqrt("med")).select((F.col("t0") + F.col("bin") * F.col("step")).alias("lo"), (F.col("t0") + (F.col("bin") + 1) * F.col("step")).alias("hi"), F.col("c").alias("n"))


def select_energy(energy: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Energy strictly inside one of the ranges."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | ((energy > lo) & (energy < hi))
    return out


def image(events: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Counts in square cells."""
    return events.groupBy(F.floor(F.col(x) / step).alias("ix"), F.floor(F.col(y) / step).alias("iy")).agg(F.count("*").alias("n"))


def counts(events: DataFrame, good: Column) -> DataFrame:
    """Number of events and of good ones."""
    return events.agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"))


def folded_chi2(events: DataFrame, t: str, period: float, n_bin: int) -> DataFrame:
    """Chi-square of counts in phase bins against a constant rate."""
    b = F.floor(F.pmod(F.col(t) / period, F.lit(1.0)) * n_bin)
    c = events.groupBy(b.alias("b")).agg(F.count("*").alias("c"))
    return c.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc")).select((F.col("cc") * n_bin / F.col("n") - F.col("n")).alias("chi2"), F.lit(n_bin - 1).alias("dof"))


def united(starts: DataFrame, s: str, length: float) -> DataFrame:
    """Intervals (lo, hi) that cover what those of one length from each start cover; at most one for each length of time."""
    near = F.floor(F.col(s) / length)  # two starts of a bucket are less than a length apart, so their intervals overlap
    return starts.groupBy(near.alias("__k")).agg(F.min(s).alias("lo"), (F.max(s) + length).alias("hi")).drop("__k")
