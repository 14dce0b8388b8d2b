"""Resampling and weighted clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import ranked
from skylattice.operators.resampling import normal_draw

#: Rows of a range of hashes that one task numbers.
PER_RANGE = 1 << 16


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from a hash of keys: the same at every run, on every machine."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from hashes (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(6.283185307179586 * uniform(seed + 1, *keys))


def shuffled_ranks(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """Number the n rows of every group from 1 (``__n``) in the order of a hash of group and unique key.

    Ranges of the hash hold about PER_RANGE rows each; a row's number is that
    within its range after the rows of the ranges before, so no task gets a
    whole group.
    """
    ranges = max(1, n // PER_RANGE)
    d = df.withColumn("__h", F.pmod(F.xxhash64(*by, key, F.lit(seed)), F.lit(1 << 40))).withColumn("__g", F.floor(F.col("__h") / (1 << 40) * ranges))
    size = d.groupBy(*by, "__g").agg(F.count("*").alias("__c"))
    first = size.withColumn("__o", F.sum("__c").over(Window.partitionBy(*by).orderBy("__g")) - F.col("__c")).drop("__c")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__g").orderBy("__h", key)))
    return d.join(first, [*by, "__g"]).withColumn("__n", F.col("__o") + F.col("__r")).drop("__h", "__g", "__r", "__o")


def correlation_significance(df: DataFrame, key: str, x: str, y: str, n_sim: int, seed: int = 1) -> DataFrame:
    """Correlation and the share of shuffles of y that correlate as strongly.

    Rows are numbered by a hash once for x and anew in every simulation for y,
    and equal numbers are paired.
    """
    d = df.select(key, x, y).dropna()
    n = d.count()
    sims = F.explode(F.sequence(F.lit(1), F.lit(n_sim))).alias("sim")
    # the order of x is the same in every simulation; neither side is sent out whole
    a = shuffled_ranks(d.withColumn("__all", F.lit(0)), ["__all"], key, n, seed + 1).select("__n", x)
    b = shuffled_ranks(d.select(key, y, sims), ["sim"], key, n, seed).select("sim", "__n", y)
    sims = b.join(a.hint("merge"), "__n").groupBy("sim").agg(F.corr(x, y).alias("r"))
    true = df.agg(F.corr(x, y).alias("corr"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))
    return sims.join(F.broadcast(true)).groupBy("corr", "n").agg(F.avg((F.abs("r") >= F.abs("corr")).cast("double")).alias("prob"))


def error_ensemble(df: DataFrame, key: str, value: str, err: str, fn, n_sim: int) -> DataFrame:
    """Mean and deviation of a function of the value when it is drawn n_sim times from its error; ``key`` is an integer id of a row."""
    d = df.select(key, value, err).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_sim))))
    d = d.select(key, fn(F.col(value) + F.col(err) * normal_draw(F.col(key).cast("bigint"), F.col("sim"))).alias("__v"))
    return d.groupBy(key).agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"))


def weighted_sigma_clip(df: DataFrame, value: str, var: str, by: Sequence[str], sigma: float = 5.0, max_iter: int = 2) -> DataFrame:
    """Inverse-variance mean after clips at sigma plain deviations from it."""
    good = df.where(F.col(value).isNotNull() & F.col(var).isNotNull()).select(*by, value, var)
    mean = (F.sum(F.col(value) / F.col(var)) / F.sum(1 / F.col(var))).alias("m")
    for _ in range(max_iter):
        s = good.groupBy(*by).agg(mean, F.stddev_samp(value).alias("s"))
        good = good.join(s, list(by)).where(F.col("s").isNull() | (F.abs(F.col(value) - F.col("m")) <= sigma * F.col("s"))).select(*by, value, var)
    return good.groupBy(*by).agg(mean, (1 / F.sum(1 / F.col(var))).alias("var"), F.count("*").alias("n_good")).withColumnRenamed("m", "mean")


def adaptive_bins(df: DataFrame, x: str, by: Sequence[str], per_bin: int) -> DataFrame:
    """Edges that put about the same number of rows in every bin."""
    d = ranked(df.select(*by, x), by, [x], "__i", "__n").withColumn("bin", F.floor((F.col("__i") - 1) / per_bin))
    return d.groupBy(*by, "bin").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))


def log_mode(df: DataFrame, value: str, step: float) -> DataFrame:
    """Centre of the fullest logarithmic bin of the positive values (ties: the lower one)."""
    b = F.floor(F.log(F.col(value)) / step)
    c = df.where(F.col(value) > 0).groupBy(b.alias("b")).agg(F.count("*").alias("n"))
    return c.agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b")).select(F.exp((F.col("b") + 0.5) * step).alias("mode"))
