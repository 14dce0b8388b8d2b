"""Transforms that no task does whole: the fast Radon transform, long Fourier transforms, correlations in blocks.

The Radon transform merges neighbouring strips of columns level by level.  A
series of up to BLOCK points is one group; a longer one is transformed in four
steps (columns, twiddle factors, rows), groups of about its square root, or,
where its length does not divide well, as a convolution of such a length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.groups import ranked
from skylattice.plans.storage import checkpointed

#: Points that one task transforms at a time.
BLOCK = 1 << 20


def fast_radon(pixels: DataFrame, partial: bool = False) -> DataFrame:
    """Sums of images (img, r, c, v) along all lines from their first to their last column: (img, dy, r, v).

    A line starts at row r and ends dy rows on; columns are filled up with
    zeros to a power of two, and so are missing pixels; what leaves the image
    counts as zero.  Of two strips the left one is read at shift dy // 2
    (towards zero), the right one as much further on as the rest of dy.
    ``partial`` returns the sums of every level: (img, level, strip, dy, r, v).

    One aggregation a level; a row is one strip at one shift, an array of the
    rows of the image.
    """
    d = pixels.where("img is not null and r >= 0 and c >= 0").groupBy("img", "c", "r").agg(F.sum(F.col("v").cast("double")).alias("v"))
    size = d.groupBy("img").agg((F.max("r") + 1).alias("rows"), F.max("c").alias("last"))
    d = d.join(size, "img").groupBy("img", "c", "rows", "last").agg(F.map_from_entries(F.collect_list(F.struct("r", F.coalesce("v", F.lit(0.0))))).alias("m"))
    line = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1), lambda r: F.coalesce(F.try_element_at(F.col("m"), r.cast(pixels.schema["r"].dataType)), F.lit(0.0)))
    levels = F.when(F.col("last") > 0, F.ceil(F.log2(F.col("last") + 1))).otherwise(0).cast("int")
    d = checkpointed(d.select("img", levels.alias("levels"), F.lit(0).alias("level"), F.col("c").cast("bigint").alias("strip"), F.lit(0).alias("dy"), line.alias("line")))
    done, most, level = [d if partial else d.where("levels = 0")], d.agg(F.max("levels")).first()[0] or 0, 0
    while level < most:
        level += 1
        pair = d.where(F.col("levels") >= level).groupBy("img", "levels", F.shiftright("strip", 1).alias("strip"), "dy").agg(F.max(F.when(F.col("strip") % 2 == 0, F.col("line"))).alias("a"), F.max(F.when(F.col("strip") % 2 == 1, F.col("line"))).alias("b"))
        wide = F.when(F.col("dy") == 0, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(2 * F.col("dy"), 2 * F.col("dy") + F.signum("dy").cast("int")))
        pair = pair.withColumn("new", F.explode(wide)).withColumn("gap", F.col("new") - F.col("dy"))
        n = F.greatest(F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0)))
        zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
        kept = F.greatest(n - F.abs("gap"), F.lit(0))
        shifted = F.when(F.col("gap") >= 0, F.concat(F.slice("b", F.least(F.col("gap"), n) + 1, kept), zeros(n - kept))).otherwise(F.concat(zeros(n - kept), F.slice("b", 1, kept)))
        both = F.zip_with(F.coalesce("a", zeros(n)), F.coalesce(shifted, zeros(n)), lambda p, q: p + q)
        d = checkpointed(pair.select("img", "levels", F.lit(level).alias("level"), "strip", F.col("new").alias("dy"), both.alias("line")))
        done.append(d if partial else d.where(F.col("levels") == level))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("img", *(["level", "strip"] if partial else []), "dy", F.posexplode("line").alias("r", "v"))


def split_length(n: int) -> int:
    """The divisor of n nearest to its square root from below."""
    k = math.isqrt(n)
    while n % k:
        k -= 1
    return k


def _columns(d: DataFrame, by: str, group: str, place: str, length: str, out: str, inverse: bool) -> DataFrame:
    """Transform of every group (by, group) along ``place`` (of ``length`` points, missing ones zero): column ``out`` counts the result."""
    kind = d.schema[by].dataType.simpleString()
    rest = [c for c in ("n", "__n1", "__n2") if c in d.columns]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(int(g[length].iloc[0]), complex)
        x[g[place].to_numpy()] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        return pd.DataFrame({by: g[by].iloc[0], group: g[group].iloc[0], out: np.arange(len(y)), "re": y.real, "im": y.imag, **{c: g[c].iloc[0] for c in rest}})

    return d.groupBy(by, group).applyInPandas(run, f"`{by}` {kind}, {group} long, {out} long, re double, im double, " + ", ".join(f"{c} long" for c in rest))


def four_step(d: DataFrame, by: str, inverse: bool = False) -> DataFrame:
    """Fourier transforms of series (by, i, re, im, n, __n1) of n points, with __n1 a divisor of n: (by, i, re, im, n); points not there are zero."""
    d = d.withColumn("__n2", (F.col("n") / F.col("__n1")).cast("long"))
    # i = n2 * a + b: transform along a for every b
    d = d.select(by, "n", "__n1", "__n2", "re", "im", F.floor(F.col("i") / F.col("__n2")).alias("__a"), (F.col("i") % F.col("__n2")).alias("__b"))
    d = _columns(d, by, "__b", "__a", "__n1", "__k1", inverse)
    turn = (2.0 if inverse else -2.0) * math.pi * ((F.col("__b") * F.col("__k1")) % F.col("n")) / F.col("n")
    d = _product(d, F.cos(turn), F.sin(turn))
    d = _columns(d, by, "__k1", "__b", "__n2", "__k2", inverse)
    return d.select(by, (F.col("__k1") + F.col("__n1") * F.col("__k2")).alias("i"), "re", "im", "n")


def _product(d: DataFrame, re, im) -> DataFrame:
    return d.withColumn("__r", F.col("re") * re - F.col("im") * im).withColumn("im", F.col("re") * im + F.col("im") * re).withColumn("re", F.col("__r")).drop("__r")


def chirp_transform(d: DataFrame, by: str) -> DataFrame:
    """Transforms of series whose lengths do not divide well (by, i, re, im, n), as a convolution with a chirp of a power of two of points."""
    # i^2 modulo 2n keeps the angle exact; i is below 2^31
    angle = math.pi * ((F.col("i") * F.col("i")) % (2 * F.col("n"))) / F.col("n")
    d = _product(d, F.cos(angle), -F.sin(angle))
    sizes = checkpointed(d.select(by, F.col("n").alias("__size")).distinct())
    power = F.ceil(F.log2(2 * F.col("__size") - 1)).cast("int")
    sizes = sizes.withColumn("n", F.pow(F.lit(2.0), power).cast("bigint")).withColumn("__n1", F.pow(F.lit(2.0), F.floor(power / 2)).cast("bigint"))
    x = four_step(d.drop("n").join(sizes, by).select(by, "i", "re", "im", "n", "__n1"), by)
    blocks = sizes.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__size") - 1) / BLOCK))))
    j = blocks.withColumn("__j", F.explode(F.sequence(F.col("__k") * BLOCK, F.least((F.col("__k") + 1) * BLOCK, F.col("__size")) - 1)))
    turn = math.pi * ((F.col("__j") * F.col("__j")) % (2 * F.col("__size"))) / F.col("__size")
    h = j.select(by, "n", "__n1", F.explode(F.array_distinct(F.array(F.col("__j"), (F.col("n") - F.col("__j")) % F.col("n")))).alias("i"), F.cos(turn).alias("re"), F.sin(turn).alias("im"))
    h = four_step(h, by).select(by, "i", F.col("re").alias("__hr"), F.col("im").alias("__hi"))
    y = _product(x.join(h, [by, "i"]), F.col("__hr"), F.col("__hi")).join(sizes.select(by, "__n1"), by)
    z = four_step(y.select(by, "i", "re", "im", "n", "__n1"), by, inverse=True)
    z = z.join(sizes.select(by, "__size"), by).where(F.col("i") < F.col("__size")).select(by, "i", "re", "im", F.col("__size").alias("n"))
    return _product(z, F.cos(angle), -F.sin(angle))


def numbered(df: DataFrame, by: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, i, n, values): rows of each series counted from 0 in an order, with their number; rows with a missing value are left out."""
    r = ranked(df.select(by, *dict.fromkeys([*order, *values])).dropna(), [by], [*order, *[v for v in values if v not in order]], "__i", "n")
    return r.select(by, (F.col("__i") - 1).alias("i"), "n", *values)


def fourier(d: DataFrame, by: str) -> DataFrame:
    """Fourier transform of numbered series (by, i, n, re, im): (by, i, re, im, n)."""
    sizes = d.select("n").distinct().where(F.col("n") > BLOCK)
    long = {r.n: split_length(r.n) for r in sizes.collect()}  # lengths of long series: fewer than rows / BLOCK
    out = _columns(d.where(F.col("n") <= BLOCK).withColumn("__g", F.lit(0).cast("long")), by, "__g", "i", "n", "__k", False).select(by, F.col("__k").alias("i"), "re", "im", "n")
    well = {n: k for n, k in long.items() if n // k <= BLOCK}
    if well:
        n1 = F.create_map(*[F.lit(x) for p in well.items() for x in p])[F.col("n")].cast("long")
        out = out.unionByName(four_step(d.where(F.col("n").isin(list(well))).withColumn("__n1", n1), by))
    if len(well) < len(long):
        out = out.unionByName(chirp_transform(d.where(F.col("n").isin([n for n in long if n not in well])).select(by, "i", "re", "im", "n"), by))
    return out


def circular_correlation(df: DataFrame, by: str, t: str, v1: str, v2: str) -> DataFrame:
    """Normalised circular cross-correlation of two columns of evenly spaced series at every lag: (by, lag, corr), by Fourier transforms.

    corr(lag) = sum of a(i + lag) b(i), about the means, over n and both
    deviations; null where one of them is constant.
    """
    d = checkpointed(numbered(df, by, [t], [v1, v2]))
    m = d.groupBy(by).agg(F.avg(v1).alias("__ma"), F.avg(v2).alias("__mb"), F.stddev_samp(v1).alias("__sa"), F.stddev_samp(v2).alias("__sb"))
    d = d.join(m, by)
    # both at once: the transform of a + i b holds those of a and of b
    f = checkpointed(fourier(d.select(by, "i", "n", (F.col(v1) - F.col("__ma")).alias("re"), (F.col(v2) - F.col("__mb")).alias("im")), by))
    g = f.select(by, ((F.col("n") - F.col("i")) % F.col("n")).alias("i"), F.col("re").alias("cr"), (-F.col("im")).alias("ci"))
    p = f.join(g, [by, "i"])
    ar, ai = (F.col("re") + F.col("cr")) / 2, (F.col("im") + F.col("ci")) / 2
    br, bi = (F.col("im") - F.col("ci")) / 2, (F.col("cr") - F.col("re")) / 2
    # the product of A and of B conjugate; its transform read backwards is the inverse one
    p = p.select(by, "i", "n", (ar * br + ai * bi).alias("re"), (ai * br - ar * bi).alias("im"))
    c = fourier(p, by).select(by, ((F.col("n") - F.col("i")) % F.col("n")).alias("lag"), (F.col("re") / F.col("n")).alias("__c"), "n")
    return c.join(m, by).select(by, "lag", F.try_divide(F.col("__c"), F.col("n") * F.col("__sa") * F.col("__sb")).alias("corr"))


def power(df: DataFrame, by: str, t: str, v: str) -> DataFrame:
    """Power spectrum of evenly spaced series of any length: (by, freq, power) up to half of the sampling frequency."""
    d = checkpointed(numbered(df.withColumn("__v", F.col(v).cast("double")), by, [t], ["__v", t] if t != v else ["__v"]))
    m = d.groupBy(by).agg(F.avg("__v").alias("mean"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    f = fourier(d.join(m, by).select(by, "i", "n", (F.col("__v") - F.col("mean")).alias("re"), F.lit(0.0).alias("im")), by)
    f = f.where(F.col("i") <= F.floor(F.col("n") / 2)).join(m, by)
    step = F.coalesce(F.nullif(F.try_divide(F.col("t1") - F.col("t0"), F.col("n") - 1), F.lit(0.0)), F.lit(1.0))
    return f.select(by, (F.col("i") / (F.col("n") * step)).alias("freq"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))


def lag_sums(df: DataFrame, by: str, i: str, v1: str, v2: str, most: int, block: int = 1 << 16) -> DataFrame:
    """Sums of v1(i) v2(i + lag) for all lags up to ``most`` either way, in blocks with a margin: (by, lag, s, n).

    Each block transforms its own rows and those within the margin; a series
    of any length is met by many tasks.
    """
    kind = df.schema[by].dataType.simpleString()
    block = max(block, 4 * most)
    d = df.select(F.col(by).alias("__by"), F.col(i).cast("long").alias("i"), F.col(v1).cast("double").alias("a"), F.col(v2).cast("double").alias("b")).where("i is not null")
    at = F.floor(F.col("i") / block)
    d = d.withColumn("k", F.explode(F.array_distinct(F.array(at, F.floor((F.col("i") - most) / block), F.floor((F.col("i") + most) / block)))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first, i = int(g["k"].iloc[0]) * block, g["i"].to_numpy()
        place, own = i - i.min(), (i >= first) & (i < first + block)
        # as long as its rows and the lags need: a short series costs a short transform
        size = 1 << (int(place.max()) + most + 1).bit_length()
        a, b, one, two = (np.zeros(size) for _ in range(4))
        ok = own & g["a"].notna().to_numpy()
        a[place[ok]], one[place[ok]] = g["a"].to_numpy()[ok], 1.0
        ok = g["b"].notna().to_numpy()
        b[place[ok]], two[place[ok]] = g["b"].to_numpy()[ok], 1.0
        f = lambda x, y: np.fft.irfft(np.conj(np.fft.rfft(x)) * np.fft.rfft(y), size)
        lags = np.arange(-most, most + 1)
        return pd.DataFrame({"__by": g["__by"].iloc[0], "lag": lags, "s": f(a, b)[lags], "n": np.rint(f(one, two)[lags]).astype(np.int64)})

    sums = d.groupBy("__by", "k").applyInPandas(run, f"__by {kind}, lag long, s double, n long")
    return sums.groupBy(F.col("__by").alias(by), "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")


def lagged_chi2(a: DataFrame, b: DataFrame, by: str, lags: Sequence[float]) -> DataFrame:
    """Chi-square and correlation of two unevenly spaced series (by, t, m, e) at lags: (by, lag, chi2, dof, corr).

    The second series is interpolated linearly, errors too, at the times of
    the first plus the lag, nowhere beyond its ends.  The difference is taken
    about its mean at each lag; deviations are of samples, that of the first
    series over all of its times.  Rows of the second of one time count as
    their mean.  Both series are sorted together once, whatever the number of lags.
    """
    point = F.struct("t", "m", "e")
    known = b.dropna(subset=["t", "m", "e"]).groupBy(by, "t").agg(F.avg("m").alias("m"), F.avg("e").alias("e")).select(by, "t", point.alias("known"), F.lit(None).cast("double").alias("lag"), F.lit(None).cast("double").alias("m1"), F.lit(None).cast("double").alias("e1"))
    asked = a.dropna(subset=["t", "m", "e"]).withColumn("lag", F.explode(F.array(*[F.lit(float(x)) for x in lags])))
    asked = asked.select(by, (F.col("t") + F.col("lag")).alias("t"), F.lit(None).cast(known.schema["known"].dataType).alias("known"), "lag", F.col("m").alias("m1"), F.col("e").alias("e1"))
    d = known.unionByName(asked)
    up, down = Window.partitionBy(by).orderBy("t"), Window.partitionBy(by).orderBy(F.desc("t"))
    # frames of values, so that points of the same time are seen from both sides
    d = d.withColumn("p", F.last("known", ignorenulls=True).over(up)).withColumn("q", F.last("known", ignorenulls=True).over(down)).where("lag is not null")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("p.t"), F.col("q.t") - F.col("p.t")), F.lit(0.0))
    d = d.select(by, "lag", "m1", "e1", (F.col("p.m") + share * (F.col("q.m") - F.col("p.m"))).alias("m2"), (F.col("p.e") + share * (F.col("q.e") - F.col("p.e"))).alias("e2"))
    diff, w = F.col("m2") - F.col("m1"), 1 / (F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))
    s = d.groupBy(by, "lag").agg(F.count("m2").alias("dof"), F.avg(diff).alias("mean"), F.sum(w).alias("w"), F.sum(w * diff).alias("wd"), F.sum(w * diff * diff).alias("wdd"), F.avg("m1").alias("a1"), F.stddev_samp("m1").alias("s1"), F.avg("m2").alias("a2"), F.stddev_samp("m2").alias("s2"), F.sum(F.col("m1") * F.col("m2")).alias("s12"), F.sum(F.when(F.col("m2").isNotNull(), F.col("m1"))).alias("t1"))
    chi2 = F.col("wdd") - 2 * F.col("mean") * F.col("wd") + F.col("mean") * F.col("mean") * F.col("w")
    cross = F.col("s12") - F.col("a2") * F.col("t1")
    return s.select(by, "lag", F.greatest(F.lit(0.0), F.coalesce(chi2, F.lit(0.0))).alias("chi2"), "dof", F.try_divide(F.try_divide(cross, F.col("s1") * F.col("s2")), F.col("dof")).alias("corr"))


def difference_interpolation(df: DataFrame, by: str, t: str, v: str, share: float) -> DataFrame:
    """Values of evenly spaced series a ``share`` of a step after each time, by the polynomial through five points: (by, at, v).

    Times that lack one of the two neighbours on either side have no value.
    """
    weights = {i: math.prod((share - j) / (i - j) for j in range(-2, 3) if j != i) for i in range(-2, 3)}
    w = Window.partitionBy(by).orderBy(t)
    value = sum((F.lit(x) * (F.lag(v, -i).over(w) if i < 0 else F.lead(v, i).over(w) if i else F.col(v)) for i, x in weights.items()), F.lit(0.0))
    d = df.select(by, (F.col(t) + share).alias("at"), value.alias("v"), (F.lead(t, 2).over(w) - F.lag(t, 2).over(w)).alias("__wide"))
    return d.where("__wide = 4").drop("__wide")
