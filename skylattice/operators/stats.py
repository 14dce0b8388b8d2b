"""Robust, weighted and binned statistics.

Everything is one aggregation, or two where a statistic needs another one
first; the first result is joined back on the group key, not kept on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import largest_group, own, ranked, row_windows, running

#: From the half interquartile range and the mean deviation to a standard deviation.
IQR_TO_STD, L1_TO_STD = 1.4826, 1.1547


def rstd(c: str) -> Column:
    """Robust standard deviation from the quartiles (linear interpolation)."""
    p = F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75)))
    return (p[1] - p[0]) / 2 * IQR_TO_STD


def quantile_disc(c: str, q: float) -> Column:
    """Quantile without interpolation: the ceil(q n)-th value."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{c}`)")


def iqr_fast(c: str) -> Column:
    return quantile_disc(c, 0.75) - quantile_disc(c, 0.25)


def wmean(value: str, err: str) -> list[Column]:
    """Mean with weights 1/err^2, its error, and the weighted deviation; rows without both values are skipped."""
    ok = F.col(value).isNotNull() & F.col(err).isNotNull()
    w, v = F.when(ok, 1 / (F.col(err) * F.col(err))), F.when(ok, F.col(value))
    mean = F.sum(v * w) / F.sum(w)
    return [mean.alias("wmean"), F.sqrt(1 / F.sum(w)).alias("wmean_err"), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * v * v) / F.sum(w) - mean * mean)).alias("wstd")]


def wmedian(df: DataFrame, value: str, err: str, by: Sequence[str]) -> DataFrame:
    """Value at which the cumulative weight (1/err^2) reaches one half, linear in between; the first weight counts as one half at most."""
    d = df.where(F.col(value).isNotNull() & F.col(err).isNotNull()).select(*by, value, err).withColumn("w", 1 / (F.col(err) * F.col(err)))
    large = largest_group(d, by)
    d = running(d, by, [value, err], "w", "__c", "__t", large).withColumn("c", F.col("__c") / F.col("__t"))
    d, w = row_windows(d, by, [value, err, "__c"], 1, 0, large)
    d = d.withColumn("c", F.when(F.col("__i") == 1, F.least(F.col("c"), F.lit(0.5))).otherwise(F.col("c")))
    d = d.withColumn("c0", F.lag("c").over(w)).withColumn("v0", F.lag(value).over(w))
    hit = own(d).where((F.col("c") >= 0.5) & (F.col("c0").isNull() | (F.col("c0") < 0.5)))
    at = F.when(F.col("c0").isNull(), F.col(value)).otherwise(F.col("v0") + (F.col(value) - F.col("v0")) * (0.5 - F.col("c0")) / (F.col("c") - F.col("c0")))
    return hit.select(*by, at.alias("wmedian"))


def std_w(df: DataFrame, value: str, err: str, by: Sequence[str]) -> DataFrame:
    """Weighted deviation around the plain mean with the (n-1)/n correction."""
    m = df.groupBy(*by).agg(F.avg(value).alias("m"))
    w = 1 / (F.col(err) * F.col(err))
    d = df.join(m, list(by)).groupBy(*by).agg(F.sum(w * F.pow(F.col(value) - F.col("m"), 2)).alias("s"), F.sum(w).alias("w"), F.count(value).alias("n"))
    return d.select(*by, F.sqrt(F.col("s") / (F.col("w") * (F.col("n") - 1) / F.col("n"))).alias("std_w"))


def rmean(df: DataFrame, value: str, by: Sequence[str], low: float = 0.1, high: float = 0.1) -> DataFrame:
    """Mean of the sorted values from ceil(n low) + 1 to floor(n (1 - high))."""
    d = ranked(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], "i", "n")
    return d.where((F.col("i") > F.ceil(F.col("n") * low)) & (F.col("i") <= F.floor(F.col("n") * (1 - high)))).groupBy(*by).agg(F.avg(value).alias("rmean"))


def rstd_l1(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute deviation from the mean, scaled."""
    m = df.groupBy(*by).agg(F.avg(value).alias("m"))
    return df.join(m, list(by)).groupBy(*by).agg((F.avg(F.abs(F.col(value) - F.col("m"))) * L1_TO_STD).alias("rstd_l1"))


def central_moment(df: DataFrame, value: str, order: int, by: Sequence[str]) -> DataFrame:
    m = df.groupBy(*by).agg(F.avg(value).alias("m"))
    return df.join(m, list(by)).groupBy(*by).agg(F.avg(F.pow(F.col(value) - F.col("m"), F.lit(order))).alias("moment"))


def sigma_clip(df: DataFrame, value: str, by: Sequence[str], sigma: float = 5.0, max_iter: int = 2) -> DataFrame:
    """Mean, variance and count after up to ``max_iter`` clips at ``sigma`` deviations; what is clipped stays clipped."""
    good = df.where(F.col(value).isNotNull()).select(*by, value)
    for _ in range(max_iter):
        s = good.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
        good = good.join(s, list(by)).where(F.col("s").isNull() | (F.abs(F.col(value) - F.col("m")) <= sigma * F.col("s"))).select(*by, value)
    return good.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count("*").alias("n_good"))


def half_open_bin(x: Column, start: float, size: float) -> Column:
    """1-based number of the (lo, hi] bin; the start itself is in none."""
    return F.ceil((x - start) / size).cast("bigint")


def binning(df: DataFrame, x: str, y: str, start: float, end: float, size: float, rescale: bool = True, fill: float | None = None) -> DataFrame:
    """Statistics in (lo, hi] bins of x, one row for every bin, also an empty one.

    With ``rescale`` the size is adjusted so that whole bins fill the range;
    ``fill`` stands for the mean of an empty bin (else null).
    """
    n = int((end - start) / size + 1e-9)
    size = (end - start) / n if rescale else size
    b = half_open_bin(F.col(x), start, size)
    stat = df.where((b >= 1) & (b <= n)).groupBy(b.alias("bin")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    every = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "bin")
    out = every.join(stat, "bin", "left")
    mean = F.col("mean") if fill is None else F.coalesce("mean", F.lit(fill))
    return out.select("bin", (start + (F.col("bin") - 0.5) * size).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"), mean.alias("mean"), "std")


def binning_npt(df: DataFrame, x: str, y: str, n_pt: int, by: Sequence[str]) -> DataFrame:
    """Bins of n_pt successive rows in order of x; an incomplete last bin is dropped."""
    d = ranked(df.select(*by, x, y), by, [x, y], "__i", "__n").withColumn("bin", F.floor((F.col("__i") - 1) / n_pt))
    return d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("std_y")).where(F.col("n") == n_pt)


def bin2d(df: DataFrame, x: str, y: str, value: str, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Count, mean and median in (lo, hi] cells of a plane."""
    d = df.withColumn("bin_x", half_open_bin(F.col(x), x0, dx)).withColumn("bin_y", half_open_bin(F.col(y), y0, dy)).where("bin_x >= 1 and bin_y >= 1")
    return d.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def overdense(df: DataFrame, x: str, y: str, dx: float, dy: float, n_sigma: float = 10.0) -> DataFrame:
    """Flag of rows in cells whose count is over mean + n_sigma robust deviations (0.5 at least)."""
    d = df.withColumn("bin_x", F.floor(F.col(x) / dx)).withColumn("bin_y", F.floor(F.col(y) / dy))
    cells = d.groupBy("bin_x", "bin_y").agg(F.count("*").alias("c"))
    limit = cells.agg((F.avg("c") + n_sigma * F.greatest(F.lit(0.5), rstd("c"))).alias("limit"))
    flagged = cells.join(F.broadcast(limit)).select("bin_x", "bin_y", (F.col("c") > F.col("limit")).alias("overdense"))
    return d.join(flagged, ["bin_x", "bin_y"])


def mode_bin(df: DataFrame, value: str, by: Sequence[str], per_bin: int = 100) -> DataFrame:
    """Centre of the fullest bin inside the interquartile range, about ``per_bin`` values a bin (ties: the lower one)."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(value).alias("k"))
    q = q.withColumn("bins", F.greatest(F.lit(1), F.floor(F.col("k") / 2 / per_bin)))
    d = df.join(q, list(by)).where(F.col(value).between(F.col("q")[0], F.col("q")[1]))
    width = (F.col("q")[1] - F.col("q")[0]) / F.col("bins")
    d = d.withColumn("b", F.least(F.col("bins") - 1, F.floor((F.col(value) - F.col("q")[0]) / width)))
    c = d.groupBy(*by, "b").agg(F.count("*").alias("c"), F.first(F.col("q")[0] + (F.col("b") + 0.5) * width).alias("mid"))
    return c.groupBy(*by).agg(F.min_by("mid", F.struct(-F.col("c"), F.col("b"))).alias("mode"))


def marginals(df: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """log(sum(exp(value))) along each axis: one pass with grouping sets."""
    sets = [[F.col(a)] for a in axes]
    return df.groupingSets(sets, *axes).agg(F.log(F.sum(F.exp(value))).alias("margin"))


def jackknife_mean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Leave-one-out error of the mean in closed form."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("jack_std"))


def bootstrap_mean(df: DataFrame, key: str, value: str, by: Sequence[str], n_sim: int) -> DataFrame:
    """Deviation of the means of n_sim Poisson resamples; weights come from an integer key, so a rerun draws the same ones."""
    from skylattice.operators.resampling import poisson_weight

    d = df.select(F.col(key).cast("bigint").alias("__key"), *by, value).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_sim)))).withColumn("w", poisson_weight(F.col("__key"), F.col("sim")))
    m = d.groupBy(*by, "sim").agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("m"))
    return m.groupBy(*by).agg(F.avg("m").alias("boot_mean"), F.stddev_samp("m").alias("boot_std"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information (nats) of two discrete columns."""
    xy = df.groupBy(x, y).agg(F.count("*").alias("nxy"))
    nx = xy.groupBy(x).agg(F.sum("nxy").alias("nx"))
    ny = xy.groupBy(y).agg(F.sum("nxy").alias("ny"))
    n = xy.agg(F.sum("nxy").alias("n"))
    j = xy.join(nx, x).join(ny, y).join(F.broadcast(n))
    return j.agg(F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"))


def median_sparse(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], every: int) -> DataFrame:
    """Median of every k-th row of a group in an order, the first included."""
    d = ranked(df.select(*dict.fromkeys([*by, *order, value])), by, order, "__k", "__n")
    return d.where(F.col("__k") % every == 1 % every).groupBy(*by).agg(F.median(value).alias("med"))


def mode_moments(df: DataFrame, value: str, by: Sequence[str], step: float, reach: int) -> DataFrame:
    """Mean and deviation of the histogram within ``reach`` bins of its fullest one: the mode and width of a peak."""
    b = df.groupBy(*by, F.floor(F.col(value) / step).alias("b")).agg(F.count("*").alias("c"))
    top = b.groupBy(*by).agg(F.min_by("b", F.struct(-F.col("c"), F.col("b"))).alias("top"))
    n = b.join(top, list(by)).where(F.abs(F.col("b") - F.col("top")) <= reach).withColumn("x", (F.col("b") + 0.5) * step)
    mean = F.sum(F.col("c") * F.col("x")) / F.sum("c")
    return n.groupBy(*by).agg(mean.alias("mode"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("c") * F.col("x") * F.col("x")) / F.sum("c") - mean * mean)).alias("std"))
