"""Measurements on images as long tables (img, r, c, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.cubes import cutouts, local_maxima
from skylattice.operators.stats import rstd


def linear_index(r: Column, c: Column, rows: int) -> Column:
    """1-based column-major index of 1-based subscripts."""
    return (c - 1) * rows + r


def subscripts(index: Column, rows: int) -> tuple[Column, Column]:
    """1-based subscripts of a 1-based column-major index."""
    return (index - 1) % rows + 1, F.floor((index - 1) / rows) + 1


def tiles(r: Column, c: Column, size: int, overlap: int) -> Column:
    """Tiles (tr, tc) that hold a pixel when neighbouring tiles share ``overlap`` pixels."""

    def along(x: Column) -> Column:
        last = F.floor(x / (size - overlap))
        first = F.greatest(F.lit(0), F.ceil((x - size + 1) / (size - overlap)))
        return F.sequence(first, last)

    return F.flatten(F.transform(along(r), lambda i: F.transform(along(c), lambda j: F.struct(i.alias("tr"), j.alias("tc")))))


def tile_background(image: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Median and robust variance of every tile."""
    t = image.withColumn("t", F.explode(tiles(F.col("r"), F.col("c"), size, overlap)))
    return t.groupBy("t.tr", "t.tc").agg(F.median("v").alias("back"), F.pow(rstd("v"), F.lit(2)).alias("var"), F.count("*").alias("n"))


def without_background(image: DataFrame, size: int) -> DataFrame:
    """Pixels less the background of their tile, and in its deviations (sn)."""
    back = tile_background(image, size)
    d = image.withColumn("tr", F.floor(F.col("r") / size)).withColumn("tc", F.floor(F.col("c") / size)).join(back, ["tr", "tc"])
    return d.select("r", "c", (F.col("v") - F.col("back")).alias("v"), F.try_divide(F.col("v") - F.col("back"), F.sqrt("var")).alias("sn"))


def find_sources(image: DataFrame, tile: int, threshold: float) -> DataFrame:
    """Local maxima over a threshold of signal to noise after background subtraction."""
    flat = without_background(image, tile)
    return local_maxima(flat).where(F.col("sn") >= threshold).select("r", "c", "v", "sn")


def moments(image: DataFrame, sources: DataFrame, half: int) -> DataFrame:
    """Aperture sum, first and second moments around each source (src, sr, sc)."""
    p = cutouts(image, sources, half).join(sources, "src").withColumn("y", F.col("r") - F.col("sr")).withColumn("x", F.col("c") - F.col("sc"))
    s = p.groupBy("src").agg(F.sum("v").alias("flux"), *[F.sum(F.col("v") * F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in (("x", "x"), ("y", "y"), ("x", "y"))], F.sum(F.col("v") * F.col("x")).alias("mx"), F.sum(F.col("v") * F.col("y")).alias("my"))
    div = lambda c: F.try_divide(F.col(c), F.col("flux"))
    return s.select("src", "flux", div("mx").alias("dx"), div("my").alias("dy"), (div("mxx") - div("mx") * div("mx")).alias("var_x"), (div("myy") - div("my") * div("my")).alias("var_y"))


def propagate(op: str, a: Column, b: Column, va: Column, vb: Column) -> tuple[Column, Column]:
    """Result and variance of a binary operator on independent pixels."""
    if op in ("+", "-"):
        return (a + b if op == "+" else a - b), va + vb
    if op == "*":
        return a * b, va * b * b + vb * a * a
    return F.try_divide(a, b), F.try_divide(va, b * b) + F.try_divide(vb * a * a, b * b * b * b)


def bounding_circle(df: DataFrame, x: str, y: str) -> DataFrame:
    """A circle around all points: centre of the box, radius to the farthest point (within sqrt 2 of the smallest)."""
    box = df.agg(((F.max(x) + F.min(x)) / 2).alias("cx"), ((F.max(y) + F.min(y)) / 2).alias("cy"))
    d = df.join(F.broadcast(box))
    far = F.max(F.pow(F.col(x) - F.col("cx"), F.lit(2)) + F.pow(F.col(y) - F.col("cy"), F.lit(2)))
    return d.groupBy("cx", "cy").agg(F.sqrt(far).alias("radius"))


def collapse(image: DataFrame, axis: str) -> DataFrame:
    """Sum, mean and median along one axis."""
    return image.groupBy(axis).agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.median("v").alias("median"))


def dense_rows(df: DataFrame, axis: str, n_sigma: float) -> DataFrame:
    """Flag of rows or columns whose count is far over the median count, in robust deviations (0.5 at least)."""
    c = df.groupBy(axis).agg(F.count("*").alias("n"))
    s = c.agg(F.median("n").alias("m"), F.greatest(F.lit(0.5), rstd("n")).alias("s"))
    return c.join(F.broadcast(s)).select(axis, "n", (F.col("n") > F.col("m") + n_sigma * F.col("s")).alias("overdense"))


def brightest_per_cell(df: DataFrame, x: str, y: str, mag: str, key: str, size: float, keep: int) -> DataFrame:
    """The brightest rows of every cell, so that dense regions do not dominate a pattern match."""
    w = Window.partitionBy("gx", "gy").orderBy(mag, key)
    d = df.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size)).withColumn("__n", F.row_number().over(w))
    return d.where(F.col("__n") <= keep).drop("__n", "gx", "gy")


def convolved(pixels: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """2-D convolution of the same size of images (img, r, c, v), zero outside and where a pixel is missing or null.

    Every pixel is added to those around it by a generated list of offsets, so
    no task holds an image; for kernels of a few dozen elements.
    """
    ny, nx = len(kernel), len(kernel[0])
    near = [(i - (ny - 1) // 2, j - (nx - 1) // 2, float(kernel[i][j])) for i in range(ny) for j in range(nx) if kernel[i][j]]
    offsets = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")) for y, x, w in near]))
    size = pixels.groupBy("img").agg(F.max("r").alias("__r"), F.max("c").alias("__c"))
    shape = size.select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__r").cast("long"))).alias("r"), "__c").select("img", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c").cast("long"))).alias("c"))
    parts = pixels.where("v is not null").select("img", "r", "c", "v", offsets.alias("o")).select("img", (F.col("r") + F.col("o.y")).cast("long").alias("r"), (F.col("c") + F.col("o.x")).cast("long").alias("c"), (F.col("v") * F.col("o.w")).alias("v"))
    sums = parts.groupBy("img", "r", "c").agg(F.sum("v").alias("v"))
    return shape.join(sums, ["img", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def mask_bits(mask: DataFrame, sources: DataFrame, half: int) -> DataFrame:
    """Bits set in any and in all pixels of a mask (r, c, f) inside a stamp around each source (src, sr, sc)."""
    near = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    stamps = sources.select("src", "sr", "sc", near.alias("y")).select("src", "sr", "sc", "y", near.alias("x")).select("src", (F.col("sr") + F.col("y")).alias("r"), (F.col("sc") + F.col("x")).alias("c"))
    return stamps.join(mask, ["r", "c"]).groupBy("src").agg(F.bit_or("f").alias("any_bits"), F.bit_and("f").alias("all_bits"))


def filter_snr(pixels: DataFrame, template: list[list[float]]) -> DataFrame:
    """Correlation of images (img, r, c, v) with a symmetric template over its noise, at the pixels they have; background and noise are robust and of the whole image."""
    s = pixels.groupBy("img").agg(F.median("v").alias("__m"), rstd("v").alias("__s"))
    d = pixels.join(s, "img").select("img", "r", "c", (F.col("v") - F.col("__m")).alias("v"))
    noise = sum(x * x for row in template for x in row) ** 0.5
    f = convolved(d, template).join(pixels.select("img", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")), ["img", "r", "c"], "left_semi")
    return f.join(s, "img").select("img", "r", "c", F.try_divide(F.col("v"), F.col("__s") * noise).alias("sn"))


def propagate_unary(op: str, a: Column, var: Column) -> tuple[Column, Column]:
    """Value and variance of a function of one value to first order."""
    value, slope = {"log": (F.log(a), 1 / a), "log10": (F.log10(a), 1 / (a * 2.302585092994046)), "exp": (F.exp(a), F.exp(a)), "sqrt": (F.sqrt(a), 1 / (2 * F.sqrt(a))), "square": (a * a, 2 * a), "-": (-a, F.lit(-1.0))}[op]
    return value, slope * slope * var
