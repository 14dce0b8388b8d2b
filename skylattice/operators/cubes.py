"""Images as long tables (r, c, v): neighbours, stamps, small kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shifted(image: DataFrame, half: int, value: str = "v") -> DataFrame:
    """Every pixel sent to the pixels around it: (r, c, dr, dc, near)."""
    steps = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    d = image.select("r", "c", F.col(value).alias("near"), F.explode(steps).alias("s"))
    return d.select((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), "near")


def local_maxima(image: DataFrame) -> DataFrame:
    """Pixels above all of their (up to eight) neighbours: one equi-join on the pixel, no range join."""
    around = shifted(image, 1).where("dr <> 0 or dc <> 0").groupBy("r", "c").agg(F.max("near").alias("near"))
    return image.join(around, ["r", "c"]).where(F.col("v") > F.col("near")).drop("near")


def cutouts(image: DataFrame, sources: DataFrame, half: int) -> DataFrame:
    """Pixels within ``half`` of each source (src, sr, sc)."""
    span = F.sequence(F.lit(-half), F.lit(half))
    s = sources.withColumn("i", F.explode(span)).withColumn("j", F.explode(span)).select("src", (F.col("sr") + F.col("i")).alias("r"), (F.col("sc") + F.col("j")).alias("c"))
    return s.join(image, ["r", "c"])


def correlate(image: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """2-D correlation with a small odd kernel; outside the image is 0."""
    half = len(kernel) // 2
    weight = F.lit(0.0)
    for i, row in enumerate(kernel):
        for j, k in enumerate(row):
            weight = F.when((F.col("dr") == i - half) & (F.col("dc") == j - half), F.lit(float(k))).otherwise(weight)
    out = shifted(image, half).groupBy("r", "c").agg(F.sum(F.col("near") * weight).alias("v"))
    return out.join(image.select("r", "c"), ["r", "c"], "left_semi")
