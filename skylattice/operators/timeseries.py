"""Folding, periodograms, correlation and light curves over long (source, time, value) tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import by_series, largest_group, quantiles
from skylattice.plans.storage import checkpointed

#: Slices of phase of a folded curve.
SLICES = 64


def phase(t: Column, t0: Column | float, period: float) -> Column:
    """Phase in [0, 1)."""
    x = (t - t0) / period
    return x - F.floor(x)


def fold(df: DataFrame, t: str, period: float, by: Sequence[str]) -> DataFrame:
    """Phase with the median time of each series as the origin."""
    mid = df.groupBy(*by).agg(F.median(t).alias("__t0"))
    return df.join(mid, list(by)).withColumn("phase", phase(F.col(t), F.col("__t0"), period)).drop("__t0")


def extract_phase(df: DataFrame, t: str, t0: float, period: float, start: float, end: float) -> DataFrame:
    """Rows with a phase in the inclusive range, which may wrap through 0."""
    p = phase(F.col(t), F.lit(t0), period)
    return df.where(p.between(start, end) if start <= end else (p >= start) | (p <= end))


def with_frequencies(df: DataFrame, freqs: Sequence[float]) -> DataFrame:
    """Every row with every frequency of a fixed grid: a generated column, not a join."""
    return df.withColumn("freq", F.explode(F.array(*[F.lit(float(f)) for f in freqs])))


def centred(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Values less their mean (``m``), with the count and variance of the series."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__a"), F.var_samp(value).alias("var"), F.count(value).alias("n"))
    return df.join(s, list(by)).withColumn("m", F.col(value) - F.col("__a")).drop("__a")


def periodogram(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Classic power |sum m exp(-2 pi i f t)|^2 / n / var; the sums are combined before the shuffle."""
    d = with_frequencies(centred(df, value, by), freqs)
    a = 2 * math.pi * F.col("freq") * F.col(t)
    s = d.groupBy(*by, "freq").agg(F.sum(F.col("m") * F.cos(a)).alias("c"), F.sum(F.col("m") * F.sin(a)).alias("s"), F.first("n").alias("n"), F.first("var").alias("var"))
    return s.select(*by, "freq", F.try_divide((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"), F.col("var")).alias("power"))


def scargle(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Lomb-Scargle power in one pass: the sums about the time offset of a frequency follow from those about the first time."""
    first = df.groupBy(*by).agg(F.min(t).alias("__t0"))
    d = with_frequencies(centred(df, value, by).join(first, list(by)), freqs)
    a = 2 * math.pi * F.col("freq") * (F.col(t) - F.col("__t0"))
    sums = {"__mc": F.col("m") * F.cos(a), "__ms": F.col("m") * F.sin(a), "__c2": F.cos(2 * a), "__s2": F.sin(2 * a)}
    s = d.groupBy(*by, "freq").agg(*[F.sum(x).alias(k) for k, x in sums.items()], F.count(t).alias("__k"), F.first("var").alias("var"))
    turn = F.atan2("__s2", "__c2") / 2
    c, w = F.cos(turn), F.sin(turn)
    half = F.hypot(F.col("__c2"), F.col("__s2")) / 2
    # of an angle that is the same at all times, what is left of the sum of squared sines is rounding
    part = lambda p, q: F.when(q > 1e-9 * F.col("__k"), p * p / q).otherwise(0.0)
    power = part(F.col("__mc") * c + F.col("__ms") * w, F.col("__k") / 2 + half) + part(F.col("__ms") * c - F.col("__mc") * w, F.col("__k") / 2 - half)
    return s.select(*by, "freq", F.try_divide(0.5 * power, F.col("var")).alias("power"))


def pdm(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float], n_bin: int) -> DataFrame:
    """Phase dispersion: variance around the means of phase bins over the whole variance."""
    d = with_frequencies(by_series(df.select(*by, t, value), by, len(freqs)), freqs).withColumn("bin", F.floor(phase(F.col(t) * F.col("freq"), F.lit(0.0), 1.0) * n_bin))
    b = d.groupBy(*by, "freq", "bin").agg(F.count(value).alias("n"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.avg(value).alias("a"))
    s = b.groupBy(*by, "freq").agg(F.sum((F.col("n") - 1) * F.col("v")).alias("inside"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a")).alias("sa"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("saa"))
    whole = F.col("inside") + F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    return s.select(*by, "freq", F.when(whole > 0, F.col("inside") / whole).alias("theta"))


def phase_entropy(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float], cells: int) -> DataFrame:
    """Entropy of the grid of phases and scaled values."""
    df = by_series(df.select(*by, t, value), by, len(freqs))
    r = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    d = with_frequencies(df.join(r, list(by)).where("hi > lo"), freqs)
    d = d.withColumn("i", F.floor(phase(F.col(t) * F.col("freq"), F.lit(0.0), 1.0) * cells)).withColumn("j", F.least(F.lit(cells - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)))
    c = d.groupBy(*by, "freq", "i", "j").agg((F.count("*") / F.first("n")).alias("p"))
    return c.groupBy(*by, "freq").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def string_length(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Length of the folded curve.

    The points are put in order within slices of phase, so a long series is
    many groups at every frequency; the slices are then linked by their ends.
    """
    d = with_frequencies(by_series(df.select(*by, t, value), by, len(freqs)), freqs).withColumn("ph", phase(F.col(t) * F.col("freq"), F.lit(0.0), 1.0))
    far = lambda a, b: F.sqrt(F.pow(a["ph"] - b["ph"], F.lit(2)) + F.pow(a["v"] - b["v"], F.lit(2)))
    w = Window.partitionBy(*by, "freq", "slice").orderBy("ph", value)
    d = d.withColumn("slice", F.floor(F.col("ph") * SLICES)).withColumns({"__p": F.lag("ph").over(w), "__v": F.lag(value).over(w)})
    at = F.struct("ph", F.col(value).alias("v"))
    d = d.select(*by, "freq", "slice", at.alias("at"), far(at, F.struct(F.col("__p").alias("ph"), F.col("__v").alias("v"))).alias("l"))
    s = d.groupBy(*by, "freq", "slice").agg(F.sum("l").alias("l"), F.min("at").alias("first"), F.max("at").alias("last"))
    link = far(F.col("first"), F.lag("last").over(Window.partitionBy(*by, "freq").orderBy("slice")))
    s = s.withColumn("link", link).withColumn("l", F.coalesce(F.col("l") + F.col("link"), "l", "link"))
    return s.groupBy(*by, "freq").agg(F.sum("l").alias("length"))


def dcf(a: DataFrame, b: DataFrame, t: str, value: str, bin_size: float, max_lag: float) -> DataFrame:
    """Discrete correlation in lag bins: pairs up to max_lag are met through time buckets of that size, never by a cross join."""
    means = lambda d, p: d.agg(F.avg(value).alias(p + "m"), F.stddev_pop(value).alias(p + "s"))
    x = a.select(F.col(t).alias("ta"), F.col(value).alias("va"), F.floor(F.col(t) / max_lag).alias("k"))
    y = b.select(F.col(t).alias("tb"), F.col(value).alias("vb"), F.explode(F.array(*[F.floor(F.col(t) / max_lag) + i for i in (-1, 0, 1)])).alias("k"))
    j = x.join(y, "k").where(F.abs(F.col("tb") - F.col("ta")) <= max_lag).join(F.broadcast(means(a, "a"))).join(F.broadcast(means(b, "b")))
    j = j.withColumn("lag_bin", F.round((F.col("tb") - F.col("ta")) / bin_size).cast("bigint")).withColumn("u", F.try_divide((F.col("va") - F.col("am")) * (F.col("vb") - F.col("bm")), F.col("as") * F.col("bs")))
    return j.groupBy("lag_bin").agg(F.avg("u").alias("dcf"), (F.stddev_samp("u") / F.sqrt(F.count("*"))).alias("dcf_err"), F.avg(F.pow(F.col("vb") - F.col("va"), F.lit(2))).alias("sf"), F.count("*").alias("n_pairs"))


def orphans(df: DataFrame, by: str, epoch: str, max_epochs: int) -> DataFrame:
    """Sources seen in 1 to max_epochs epochs."""
    return df.groupBy(by).agg(F.count_distinct(epoch).alias("n_det")).where(F.col("n_det").between(1, max_epochs))


def clean_orphans(df: DataFrame, by: str, epoch: str, snr: str, max_epochs: int = 3) -> DataFrame:
    """Orphans in successive epochs whose mean signal to noise is at least max(9 - n_det, 5)."""
    d = df.groupBy(by, epoch).agg(F.avg(snr).alias("s"))
    a = d.groupBy(by).agg(F.count("*").alias("n_det"), (F.max(epoch) - F.min(epoch) + 1).alias("span"), F.avg("s").alias("mean_snr"))
    return a.where((F.col("n_det") <= max_epochs) & (F.col("span") == F.col("n_det")) & (F.col("mean_snr") >= F.greatest(9 - F.col("n_det"), F.lit(5)))).drop("span")


def zero_points(df: DataFrame, source: str, epoch: str, mag: str, ref_epoch: int) -> DataFrame:
    """Median over the sources of magnitude minus that in the reference epoch, by epoch."""
    ref = df.where(F.col(epoch) == ref_epoch).select(source, F.col(mag).alias("__r"))
    both = df.join(ref, source).select(epoch, (F.col(mag) - F.col("__r")).alias("zp"))
    # every row has at most one reference unless a source has several in its epoch
    large = largest_group(df, [epoch])
    return quantiles(both, [epoch], "zp", {"zp": 0.5}, large).withColumnRenamed("__n", "n")


def relative_photometry(df: DataFrame, source: str, epoch: str, mag: str, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Zero points and source means of mag = zp(epoch) + mean(source), by alternating averages; checkpointed every round."""
    means = df.groupBy(source).agg(F.avg(mag).alias("mean"))
    zps = None
    for _ in range(rounds):
        zps = checkpointed(df.join(means, source).groupBy(epoch).agg(F.avg(F.col(mag) - F.col("mean")).alias("zp")))
        means = checkpointed(df.join(zps, epoch).groupBy(source).agg(F.avg(F.col(mag) - F.col("zp")).alias("mean")))
    return zps, means


def sysrem(df: DataFrame, source: str, epoch: str, resid: str, sigma: str, rounds: int = 3) -> DataFrame:
    """Residuals less their best rank-one part c(source) a(epoch), by alternating least squares."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    a = df.select(epoch).distinct().withColumn("a", F.lit(1.0))
    c = None
    for _ in range(rounds):
        c = checkpointed(df.join(a, epoch).groupBy(source).agg(F.try_divide(F.sum(F.col(resid) * F.col("a") * w), F.sum(F.col("a") * F.col("a") * w)).alias("c")))
        a = checkpointed(df.join(c, source).groupBy(epoch).agg(F.try_divide(F.sum(F.col(resid) * F.col("c") * w), F.sum(F.col("c") * F.col("c") * w)).alias("a")))
    return df.join(c, source).join(a, epoch).withColumn("clean", F.col(resid) - F.col("c") * F.col("a")).drop("c", "a")


def fit_motion(df: DataFrame, source: str, t: str, coord: str, err: float, min_obs: int = 3) -> DataFrame:
    """Constant and linear model of a coordinate per source: rate, intercept at the mean time and the gain in chi-square."""
    s = df.groupBy(source).agg(F.regr_slope(coord, t).alias("rate"), F.avg(coord).alias("mean"), F.avg(t).alias("t_mean"), F.regr_syy(coord, t).alias("syy"), F.regr_sxy(coord, t).alias("sxy"), F.regr_sxx(coord, t).alias("sxx"), F.count("*").alias("n"))
    return s.where((F.col("n") >= min_obs) & (F.col("sxx") > 0)).select(source, "rate", "mean", "n", (F.col("sxy") * F.col("sxy") / F.col("sxx") / (err * err)).alias("d_chi2"))


def detrend(df: DataFrame, t: str, value: str, by: Sequence[str]) -> DataFrame:
    """Values less the straight line through each series."""
    s = df.groupBy(*by).agg(F.regr_slope(value, t).alias("__b"), F.avg(value).alias("__y"), F.avg(t).alias("__x"))
    return df.join(s, list(by)).withColumn("resid", F.col(value) - F.col("__y") - F.coalesce("__b", F.lit(0.0)) * (F.col(t) - F.col("__x"))).drop("__b", "__y", "__x")


def structure_function(df: DataFrame, t: str, value: str, by: Sequence[str], bin_size: float, max_lag: float) -> DataFrame:
    """Mean squared difference of pairs of a series in lag bins, pairs met through time buckets."""
    a = df.select(*by, F.col(t).alias("ta"), F.col(value).alias("va"), F.floor(F.col(t) / max_lag).alias("k"))
    b = df.select(*by, F.col(t).alias("tb"), F.col(value).alias("vb"), F.explode(F.array(F.floor(F.col(t) / max_lag), F.floor(F.col(t) / max_lag) - 1)).alias("k"))
    j = a.join(b, [*by, "k"]).where((F.col("tb") > F.col("ta")) & (F.col("tb") - F.col("ta") <= max_lag))
    return j.groupBy(F.floor((F.col("tb") - F.col("ta")) / bin_size).alias("lag_bin")).agg(F.avg(F.pow(F.col("vb") - F.col("va"), F.lit(2))).alias("sf"), F.count("*").alias("n_pairs"))


def stat_summary(df: DataFrame, source: str, value: str) -> DataFrame:
    """Mean, median, deviation, robust deviation, range, extremes and count per source, in one pass."""
    from skylattice.operators.stats import rstd

    return df.groupBy(source).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), rstd(value).alias("rstd"), (F.max(value) - F.min(value)).alias("range"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_obs"))
