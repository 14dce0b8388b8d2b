"""Small fits per series: polynomials, harmonics, interpolators, filters.

Least-squares fits need only sums, which Spark combines before the shuffle;
the small systems of those sums are solved with numpy, one row a series.
Running filters are windows or joins through time buckets.  What has neither
form (a transform, an interpolator) takes a series as a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from skylattice.operators.groups import by_series, in_one_task, largest_group, row_windows, spread_join

#: Modulus of the hash that draws rows: squares of what is below it are 64-bit integers.
PRIME = 2147483647


def solved(sums: DataFrame, by: str, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that a numpy function makes of each row of sums (key ``__key``); the key is named ``by``."""
    kind = sums.schema["__key"].dataType.simpleString()
    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = [(key, *[x[n] for n in names]) for key, row in zip(g["__key"], g.to_dict("records"), strict=True) for x in fn(row)]
            yield pd.DataFrame(rows, columns=[by, *names])

    return sums.mapInPandas(run, f"{by} {kind}, {schema}")


def moments(df: DataFrame, by: str, t: str, v: str, degree: int) -> DataFrame:
    """Sums of powers of the scaled time u = (t - mean) / deviation: s0.., y0.. (times v - mean), yy, and what scales them back."""
    d = df.select(F.col(by).alias("__key"), F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")).dropna(subset=["t", "v"])
    scale = d.groupBy("__key").agg(F.avg("t").alias("tm"), F.stddev_pop("t").alias("ts"), F.avg("v").alias("vm"), F.count("*").alias("n"), F.count_distinct("t").alias("times"))
    u, y = F.coalesce(F.try_divide(F.col("t") - F.col("tm"), F.col("ts")), F.lit(0.0)), F.col("v") - F.col("vm")
    power = lambda k: F.pow(u, F.lit(k))
    sums = [F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * y).alias(f"y{k}") for k in range(degree + 1)]
    return d.join(scale, "__key").groupBy("__key", "tm", "ts", "vm", "n", "times").agg(*sums, F.sum(y * y).alias("yy"))


def fitted(row: dict, degree: int) -> tuple[np.ndarray, float]:
    """Coefficients (lowest first, in scaled time) and chi-square of one degree."""
    a = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    y = np.array([row[f"y{i}"] for i in range(degree + 1)])
    c = np.linalg.solve(a, y)
    return c, max(0.0, float(row["yy"] - c @ y))


def polynomial(df: DataFrame, by: str, t: str, v: str, degree: int) -> DataFrame:
    """Least-squares polynomial about the mean time: coefficients from the highest, chi-square, count.

    A series with too few different times gets the highest degree they allow.
    """

    def fn(row: dict) -> list[dict]:
        c, chi2 = fitted(row, min(degree, int(row["times"]) - 1))
        c = c / np.power(row["ts"] or 1.0, np.arange(len(c)))
        c[0] += row["vm"]
        return [{"coef": c[::-1].tolist(), "chi2": chi2, "n": int(row["n"])}]

    return solved(moments(df, by, t, v, degree), by, fn, "coef array<double>, chi2 double, n long")


def polynomial_hypothesis(df: DataFrame, by: str, t: str, v: str, err: float, degree: int = 2) -> DataFrame:
    """Gain in chi-square of each polynomial degree over a constant."""

    def fn(row: dict) -> list[dict]:
        chi = [fitted(row, k)[1] / err**2 for k in range(min(degree, int(row["times"]) - 1) + 1)]
        return [{"degree": k, "d_chi2": chi[0] - c} for k, c in enumerate(chi)]

    return solved(moments(df, by, t, v, degree), by, fn, "degree long, d_chi2 double")


def harmonics(df: DataFrame, by: str, t: str, v: str, freq: float, n: int = 2) -> DataFrame:
    """Fit of a constant and n harmonics of a frequency: amplitudes and residual deviation, from the sums of products of its terms."""
    d = df.select(F.col(by).alias("__key"), F.col(t).alias("t"), F.col(v).cast("double").alias("v")).dropna(subset=["t", "v"])
    terms = [F.lit(1.0), *[f(2 * math.pi * freq * k * F.col("t")) for k in range(1, n + 1) for f in (F.cos, F.sin)]]
    size = len(terms)
    mean = d.groupBy("__key").agg(F.avg("v").alias("vm"))
    y = F.col("v") - F.col("vm")
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(i + 1)]
    sums += [F.sum(terms[i] * y).alias(f"y{i}") for i in range(size)] + [F.sum(y * y).alias("yy"), F.count("*").alias("n")]

    def fn(row: dict) -> list[dict]:
        a = np.array([[row[f"a{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
        b = np.array([row[f"y{i}"] for i in range(size)])
        p = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        left = max(0.0, row["yy"] - 2 * p @ b + p @ a @ p) / row["n"]
        # the terms hold a constant, so residuals have no mean but what rounding leaves
        return [{"amplitude": np.hypot(p[1::2], p[2::2]).tolist(), "resid_std": float(np.sqrt(left))}]

    return solved(d.join(mean, "__key").groupBy("__key").agg(*sums), by, fn, "amplitude array<double>, resid_std double")


def lag_correlation(df: DataFrame, by: str, t: str, v1: str, v2: str, max_lag: int) -> DataFrame:
    """Correlation of two evenly spaced columns of a series at every lag up to max_lag; 0 where one of them is constant."""
    d = df.select(F.col(by).alias("__key"), F.col(t).alias("t"), F.col(v1).cast("double").alias("a"), F.col(v2).cast("double").alias("b")).dropna()
    large = largest_group(d, ["__key"])
    m = d.groupBy("__key").agg(F.avg("a").alias("am"), F.avg("b").alias("bm"), F.count("*").alias("n"))
    d = d.join(m, "__key").withColumn("a", F.col("a") - F.col("am")).withColumn("b", F.col("b") - F.col("bm"))
    lags = list(range(-max_lag, max_lag + 1))
    d, w = row_windows(d, ["__key"], ["t"], max_lag, max_lag, large)
    d = d.select("__key", "n", "a", "b", "__own", *[F.lead("b", k).over(w).alias(f"b{i}") for i, k in enumerate(lags)]).where("__own")
    s = d.groupBy("__key", "n").agg(F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))).alias("norm"), *[F.coalesce(F.sum(F.col("a") * F.col(f"b{i}")), F.lit(0.0)).alias(f"c{i}") for i in range(len(lags))])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.coalesce(F.try_divide(F.col(f"c{i}"), F.col("norm")), F.lit(0.0)).alias("corr")) for i, k in enumerate(lags)])
    return s.select("__key", "n", F.explode(rows).alias("r")).where(F.abs("r.lag") < F.col("n")).select(F.col("__key").alias(by), "r.lag", "r.corr")


def gaussian_process(df: DataFrame, by: str, t: str, v: str, grid: Sequence[float], length: float, noise: float, reach: float = 6.0) -> DataFrame:
    """Gaussian-process interpolation with a squared-exponential kernel at fixed times.

    The kernel is cut at ``reach`` lengths (where it is below 2e-8), so each
    time of the grid is a group of the rows around it, not of a whole series;
    a time without rows around it gets the mean of its series.
    """
    d = df.select(F.col(by).alias("__key"), F.col(t).cast("double").alias("x"), F.col(v).cast("double").alias("y")).dropna(subset=["x", "y"])
    kind = d.schema["__key"].dataType.simpleString()
    s = d.groupBy("__key").agg(F.avg("y").alias("m"), F.var_pop("y").alias("var"))
    near = d.withColumn("g", F.explode(F.array(*[F.lit(float(g)) for g in grid]).cast("array<double>"))).where(F.abs(F.col("x") - F.col("g")) <= reach * length)
    every = s.select("__key", "m", "var", F.explode(F.array(*[F.lit(float(g)) for g in grid]).cast("array<double>")).alias("g"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["x"]).sort_values(["x", "y"]) if g.x.notna().any() else g
        at, mean, scale = float(g.g.iloc[0]), float(g.m.iloc[0]), max(float(g["var"].iloc[0]), 1e-12)
        value = mean
        if g.x.notna().any():
            x, y = g.x.to_numpy(), g.y.to_numpy() - mean
            k = lambda a, b: scale * np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * length**2))
            value += float((k(np.array([at]), x) @ np.linalg.solve(k(x, x) + noise**2 * np.eye(len(x)), y))[0])
        return pd.DataFrame({"__key": [g["__key"].iloc[0]], "t_new": [at], "value": [value]})

    out = every.join(near, ["__key", "g"], "left").groupBy("__key", "g").applyInPandas(solve, f"__key {kind}, t_new double, value double")
    return out.withColumnRenamed("__key", by)


#: Half frames of a stretch of :func:`savitzky_golay`, and the sums that a parabola takes.
BLOCK, _SUMS = 16, ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2")


def savitzky_golay(df: DataFrame, by: str, t: str, v: str, frame: float) -> DataFrame:
    """Local parabola at every row from the rows within half a frame, also for uneven spacing.

    Rows of a time are one, with their count and sum; windows over stretches
    of BLOCK half frames, with copies of the neighbours' edges, list the times
    of every frame.  A frame with fewer than three different times gives the
    line or the mean that they allow.
    """
    half = frame / 2
    d = df.select(F.col(by).alias("__key"), F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")).dropna()
    d = by_series(d, ["__key"], 2).groupBy("__key", "t").agg(F.count("*").alias("rows"), F.sum("v").alias("y"))
    bucket = F.floor(F.col("t") / half)
    block, place = F.floor(bucket / BLOCK), F.pmod(bucket, F.lit(BLOCK))
    # one bucket more than a frame reaches on either side, for times on an edge
    d = d.withColumn("__home", block).withColumn("__block", F.explode(F.array_compact(F.array(block, F.when(place < 2, block - 1), F.when(place >= BLOCK - 2, block + 1)))))
    # the frame is a little wider than what is taken of it
    over = Window.partitionBy("__key", "__block").orderBy(F.col("t") / (half * (1 + 1e-9))).rangeBetween(-1, 1)
    d = d.withColumn("__near", F.collect_list(F.struct("t", "rows", "y")).over(over)).where(F.col("__block") == F.col("__home"))
    u = lambda x: (x["t"] - F.col("t")) / half
    near = F.filter("__near", lambda x: F.abs(u(x)) <= 1)
    near = F.transform(near, lambda x: F.struct(u(x).alias("u"), x["rows"].cast("double").alias("n"), x["y"].alias("y")))
    d = d.select("__key", F.col("t").alias("ta"), "rows", near.alias("__near"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in _SUMS])

    def add(s: Column, x: Column) -> Column:
        u, n, y = x["u"], x["n"], x["y"]
        terms = [n, n * u, n * u * u, n * u * u * u, n * u * u * u * u, y, y * u, y * u * u]
        return F.struct(*[(s[c] + term).alias(c) for c, term in zip(_SUMS, terms, strict=True)])

    m = d.select("__key", "ta", "rows", F.aggregate("__near", zero, add).alias("s"), F.size("__near").alias("times")).select("__key", "ta", "rows", "times", "s.*")
    s0, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2"))
    minor = s2 * s4 - s3 * s3
    parabola = (y0 * minor - y1 * (s1 * s4 - s2 * s3) + y2 * (s1 * s3 - s2 * s2)) / (s0 * minor - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
    line = (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1)
    smooth = F.when(F.col("times") > 2, parabola).when(F.col("times") == 2, line).otherwise(y0 / s0)
    out = m.select(F.col("__key").alias(by), F.col("ta").alias("t"), smooth.alias("smooth"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return out.drop("copy")


def ransac_line(df: DataFrame, by: str, key: str, t: str, v: str, tolerance: float, n_sim: int = 100, seed: int = 1) -> DataFrame:
    """Line with the most rows within a tolerance over seeded pairs, refitted to them: slope, intercept, n_in.

    A hash of the integer ``key`` orders the rows of a series; its first
    n_sim / 2 + 1 rows, each with the next and the one after that, are the
    pairs.  Lines are counted as (series, line) with partial sums, so no task
    gets a whole series.  A series without two different times has slope 0.
    """
    d = df.select(F.col(by).alias("__key"), F.col(key).alias("id"), F.col(t).cast("double").alias("x"), F.col(v).cast("double").alias("y")).dropna()
    small = F.pmod(F.pmod("id", F.lit(PRIME)) * 48271 + seed, F.lit(PRIME))
    d = d.withColumn("h", F.pmod(small * small, F.lit(PRIME)))
    wanted = n_sim // 2 + 1
    size = d.groupBy("__key").agg(F.count("*").alias("n"))
    # about twice the rows that are wanted are put in order, however long the series
    drawn = spread_join(d, size, "__key", F.col("id")).where(F.col("h") / PRIME <= F.lit(2.0 * wanted) / F.col("n"))
    w = Window.partitionBy("__key").orderBy("h", "id", "x", "y")
    drawn = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= wanted)
    drawn = drawn.select("__key", F.col("x").alias("x0"), F.col("y").alias("y0"), *[F.struct((F.col("r") * 2 + k).alias("line"), F.lead("x", k).over(w).alias("x1"), F.lead("y", k).over(w).alias("y1")).alias(f"p{k}") for k in (1, 2)])
    lines = drawn.select("__key", "x0", "y0", F.explode(F.array("p1", "p2")).alias("p")).where("p.x1 <> x0")
    lines = lines.select("__key", "x0", "y0", "p.line", ((F.col("p.y1") - F.col("y0")) / (F.col("p.x1") - F.col("x0"))).alias("b"))
    near = F.abs(F.col("y") - F.col("y0") - F.col("b") * (F.col("x") - F.col("x0"))) <= tolerance
    votes = spread_join(d.select("__key", "id", "x", "y"), lines, "__key", F.col("id")).where(near)
    votes = votes.groupBy("__key", "line").agg(F.count("*").alias("votes"), F.first(F.struct("x0", "y0", "b")).alias("of"))
    best = votes.groupBy("__key").agg(F.max_by("of", F.struct("votes", -F.col("line"))).alias("of")).select("__key", "of.*")
    inside = spread_join(d.select("__key", "id", "x", "y"), size.join(best, "__key", "left").drop("n"), "__key", F.col("id")).where(F.col("b").isNull() | near)
    fit = inside.groupBy("__key").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("xm"), F.avg("y").alias("ym"), F.count("*").alias("n_in"))
    return fit.select(F.col("__key").alias(by), "slope", (F.col("ym") - F.col("slope") * F.col("xm")).alias("intercept"), "n_in")


def _scaled() -> Column:
    return F.coalesce(F.try_divide(F.col("v") - F.col("vm"), F.col("vs")), F.lit(0.0))


def matched_filter(df: DataFrame, by: str, t: str, v: str, template: Sequence[float]) -> DataFrame:
    """Highest correlation of a series with a unit-energy template, in deviations of the series, and its place from 0 (the first of equal ones)."""
    w = np.asarray(template, float)
    w = (w - w.mean()) / np.linalg.norm(w - w.mean())
    d = df.select(F.col(by).alias("__key"), F.col(t).alias("t"), F.col(v).cast("double").alias("v")).dropna()
    dealt, last = in_one_task(d, ["__key"], 2), len(w) - 1
    if dealt is not None:
        # one order serves all windows of a series, and tasks are as many as keep them small
        d, over = row_windows(dealt, ["__key"], ["t", "v"], 0, last, 0)
        whole = Window.partitionBy("__key")
        d = d.withColumn("vm", F.avg("v").over(whole)).withColumn("vs", F.stddev_pop("v").over(whole)).withColumn("y", _scaled())
    else:
        m = d.groupBy("__key").agg(F.avg("v").alias("vm"), F.stddev_pop("v").alias("vs"))
        d, over = row_windows(d.join(m, "__key").withColumn("y", _scaled()), ["__key"], ["t", "v"], 0, last)
    corr = reduce(lambda a, b: a + b, [F.lead("y", k).over(over) * float(x) if k else F.col("y") * float(x) for k, x in enumerate(w)])
    c = d.select("__key", corr.alias("c"), (F.col("__i") - 1).alias("i"), "__own").where("__own")
    best = c.groupBy("__key").agg(F.max("c").alias("best"), F.min_by("i", F.struct(F.col("c").isNull(), -F.col("c"), F.col("i"))).alias("at"))
    return best.select(F.col("__key").alias(by), F.coalesce("best", F.lit(0.0)).alias("best"), F.when(F.col("best").isNotNull(), F.col("at")).otherwise(F.lit(0)).alias("at"))


def kepler(mean_anomaly: Column, eccentricity: Column) -> Column:
    """Eccentric anomaly (radians) by vectorised Newton steps."""

    @F.pandas_udf("double")
    def solve(m: pd.Series, e: pd.Series) -> pd.Series:
        m, e = m.to_numpy(float), e.to_numpy(float)
        x = m + e * np.sin(m)
        for _ in range(20):
            x = x - (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
        return pd.Series(x)

    return solve(mean_anomaly, eccentricity)


def radon(image: np.ndarray, angles: int = 64) -> np.ndarray:
    """Sums of an image along lines: rows are angles, columns offsets from the centre."""
    ny, nx = image.shape
    y, x = np.mgrid[:ny, :nx]
    r = int(np.ceil(np.hypot(ny, nx)))
    out = np.zeros((angles, r + 1))
    for k in range(angles):
        a = np.pi * k / angles
        off = np.rint((x - (nx - 1) / 2) * np.cos(a) + (y - (ny - 1) / 2) * np.sin(a)).astype(int) + r // 2
        np.add.at(out[k], np.clip(off, 0, r), image)
    return out


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """2-D convolution of the same size by FFT, zero outside."""
    shape = [a + b - 1 for a, b in zip(image.shape, kernel.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(kernel, shape), shape)
    dy, dx = ((k - 1) // 2 for k in kernel.shape)
    return full[dy : dy + image.shape[0], dx : dx + image.shape[1]]


def per_image(pixels: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply an array function to every image of a long table (img, r, c, v); missing pixels are 0."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(g.r.max()) + 1, int(g.c.max()) + 1))
        a[g.r.to_numpy(int), g.c.to_numpy(int)] = g.v.fillna(0).to_numpy()
        out = fn(a)
        r, c = np.indices(out.shape)
        return pd.DataFrame({"img": g.img.iloc[0], "r": r.ravel(), "c": c.ravel(), "v": out.ravel()})

    return pixels.select(F.col("img").cast("long").alias("img"), "r", "c", "v").groupBy("img").applyInPandas(run, "img long, r long, c long, v double")
