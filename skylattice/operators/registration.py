"""Rotation and scale between two planar lists, from histograms of their pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.spatial import plane_place_pairs


def pair_histogram(points: DataFrame, radius: float, n_angle: int, log_step: float) -> DataFrame:
    """Counts of (log distance, direction) of the pairs within a radius; its size depends on the bins alone."""
    j = plane_place_pairs(points, points, radius).where("dist > 0")
    angle = F.pmod(F.atan2(F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")), F.lit(2 * math.pi))
    return j.groupBy(F.round(F.log("dist") / log_step).cast("int").alias("ld"), (F.round(angle / (2 * math.pi) * n_angle) % n_angle).cast("int").alias("an")).agg(F.sum(F.col("p.n") * F.col("q.n")).alias("n"))


def rotation_and_scale(a: DataFrame, b: DataFrame, radius: float, max_scale: float = 1.5, n_angle: int = 360, log_step: float = 0.02) -> DataFrame:
    """The (angle, scale) that maps most pairs of ``a`` on pairs of ``b``: the highest correlation of the two histograms."""
    x = pair_histogram(a, radius, n_angle, log_step).select(F.col("ld").alias("la"), F.col("an").alias("aa"), F.col("n").alias("na"))
    y = pair_histogram(b, radius * max_scale, n_angle, log_step).select(F.col("ld").alias("lb"), F.col("an").alias("ab"), F.col("n").alias("nb"))
    reach = int(math.log(max_scale) / log_step) + 1
    x = x.withColumn("lb", F.explode(F.sequence(F.col("la") - reach, F.col("la") + reach)))
    h = x.join(y, "lb").groupBy((F.col("lb") - F.col("la")).alias("dl"), F.pmod(F.col("ab") - F.col("aa"), F.lit(n_angle)).alias("da")).agg(F.sum(F.col("na").cast("decimal(18,0)") * F.col("nb").cast("decimal(18,0)")).alias("s"))  # past the range of a long
    best = h.agg(F.max(F.struct("s", (-F.col("dl")).alias("ml"), (-F.col("da")).alias("ma"))).alias("m"))
    return best.select((-F.col("m.ma") * 360.0 / n_angle).alias("angle"), F.exp(-F.col("m.ml") * log_step).alias("scale"), F.col("m.s").alias("score"))
