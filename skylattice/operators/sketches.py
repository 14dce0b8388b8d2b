"""Stored summaries that are merged without reading rows again: quantiles within a relative error, distinct counts.

A quantile sketch is a table of counts by bucket of the logarithm, so merging
is a sum; a distinct-count sketch is one of Spark's own, kept as bytes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values nearer to zero than this count as zero.
LEAST = 1e-12
#: Bits of a distinct-count sketch; its standard error is 1.04 / sqrt(2**bits), or less.
HLL_BITS = 12


def quantile_sketch(df: DataFrame, value: str, by: Sequence[str], error: float = 0.01) -> DataFrame:
    """Counts by bucket (by, sign, bucket, n): each bucket holds values within ``error`` of its middle; missing values are left out.

    A group has no more rows than its range has buckets, about ln(max/min) / (2 error).
    """
    gamma = (1 + error) / (1 - error)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    d = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull())
    sign = F.when(F.abs("__v") < LEAST, 0).otherwise(F.signum("__v")).cast("int")
    bucket = F.when(sign == 0, 0).otherwise(F.ceil(F.log(F.abs("__v")) / math.log(gamma))).cast("long")
    return d.groupBy(*by, sign.alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """A sketch of coarser groups (columns of the sketch)."""
    return sketch.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantile(sketch: DataFrame, by: Sequence[str], share: float, error: float = 0.01) -> DataFrame:
    """(by, n, value): the value of rank ceil(share n) of every group, within ``error`` of it; n is exact."""
    gamma = (1 + error) / (1 - error)
    s = merged(sketch, by).withColumn("place", F.col("sign") * F.col("bucket"))
    w = Window.partitionBy(*by)
    s = s.withColumn("upto", F.sum("n").over(w.orderBy("sign", "place"))).withColumn("all", F.sum("n").over(w))
    at = F.greatest(F.lit(1), F.ceil(F.col("all") * share))
    middle = F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    return s.where((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at)).select(*by, F.col("all").alias("n"), middle.alias("value"))


def distinct_sketch(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, sketch): mergeable distinct-count sketches."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, HLL_BITS).alias("sketch"))


def distinct_estimate(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n): distinct values of the union of the sketches of a group."""
    return sketch.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def within(value: Column, exact: Column, error: float) -> Column:
    return F.abs(value - exact) <= error * F.abs(exact) + LEAST
