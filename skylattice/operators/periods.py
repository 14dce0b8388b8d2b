"""Further period searches over a fixed grid of frequencies; sums are combined before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators import groups
from skylattice.operators.groups import by_series, in_one_task, ranked
from skylattice.operators.timeseries import centred, phase, with_frequencies


def two_harmonics(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Power of every frequency and its double, in units of the variance."""
    d = with_frequencies(centred(df, value, by), freqs)
    a = 2 * math.pi * F.col("freq") * F.col(t)
    terms = [F.sum(F.col("m") * f(k * a)).alias(f"{n}{k}") for k in (1, 2) for n, f in (("c", F.cos), ("s", F.sin))]
    s = d.groupBy(*by, "freq").agg(*terms, F.first("n").alias("n"), F.first("var").alias("var"))
    power = sum(F.col(c) * F.col(c) for c in ("c1", "s1", "c2", "s2")) / F.col("n")
    return s.select(*by, "freq", F.try_divide(power, F.col("var")).alias("power"))


def fourier_sums(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float]) -> DataFrame:
    """Real and imaginary part of the sum of centred values times exp(-2 pi i f t)."""
    d = with_frequencies(centred(df, value, by), freqs)
    a = 2 * math.pi * F.col("freq") * F.col(t)
    return d.groupBy(*by, "freq").agg(F.sum(F.col("m") * F.cos(a)).alias("re"), (-F.sum(F.col("m") * F.sin(a))).alias("im"))


def phase_information(df: DataFrame, t: str, value: str, by: Sequence[str], freqs: Sequence[float], cells: int) -> DataFrame:
    """Mutual information (nats) of the phase and the scaled value, each in a number of cells."""
    df = by_series(df.select(*by, t, value), by, len(freqs))
    r = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    d = with_frequencies(df.join(r, list(by)).where("__hi > __lo"), freqs)
    i = F.floor(phase(F.col(t) * F.col("freq"), F.lit(0.0), 1.0) * cells)
    j = F.least(F.lit(cells - 1), F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells))
    c = d.groupBy(*by, "freq", i.alias("i"), j.alias("j")).agg(F.count("*").alias("c"))
    # cells are few: the margins are windows over at most cells^2 rows
    all_, one = Window.partitionBy(*by, "freq"), lambda k: Window.partitionBy(*by, "freq", k)
    c = c.withColumn("n", F.sum("c").over(all_)).withColumn("ni", F.sum("c").over(one("i"))).withColumn("nj", F.sum("c").over(one("j")))
    return c.groupBy(*by, "freq").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ni") * F.col("nj")))).alias("information"))


def shuffled_power(df: DataFrame, key: str, t: str, value: str, by: Sequence[str], freq: float, n_sim: int) -> DataFrame:
    """Power at a frequency and how many shuffles of the values have as much.

    The order of a shuffle is that of a digest of the unique key and its
    number, so every run draws the same.  Digests name the rows, ranks pair
    them within every shuffle and series.  Short series go to one task each
    before they multiply.
    """
    df, keys, x = df.select(*by, key, t, value), [*by, "sim"], 2 * math.pi * freq * F.col("__x")
    sims = lambda df: df.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sim))))
    drawn = F.when(F.col("sim") == 0, F.lpad(F.col("__id_").cast("string"), 32, "0")).otherwise(F.md5(F.concat_ws(":", F.col("__id_").cast("string"), F.col("sim").cast("string"))))
    dealt = in_one_task(df, by, 2 * (n_sim + 1))
    if dealt is not None:
        # a row has its place in time once; times and values of a shuffle meet at their number within the task
        w, v = Window.partitionBy(*by), F.col(value)
        d = dealt.dropna(subset=list(by)).withColumn("__i", F.row_number().over(w.orderBy(key)))
        d = d.select(*by, "__i", F.col(key).alias("__id_"), F.col(t).cast("double").alias("__x"), (v - F.avg(v).over(w)).alias("__m"), F.count(v).over(w).alias("n"), F.var_samp(v).over(w).alias("var"))
        d = sims(d).withColumn("__j", F.row_number().over(Window.partitionBy(*keys).orderBy(drawn, "__id_")))
        none = F.lit(None).cast("double")
        pair = F.array(F.struct(F.col("__i").alias("i"), F.col("__x").alias("x"), none.alias("m")), F.struct(F.col("__j").alias("i"), none.alias("x"), F.col("__m").alias("m")))
        d = d.select(*keys, "n", "var", F.explode(pair).alias("__p"))
        met = d.groupBy(*keys, "__p.i").agg(F.max("__p.x").alias("__x"), F.max("__p.m").alias("__m"), F.max("n").alias("n"), F.max("var").alias("var"))
    else:
        d, large = centred(df, value, by).select(*by, F.col(key).alias("__id_"), F.col(t).alias("__x"), F.col("m").alias("__m"), "n", "var"), groups.GROUP_ROWS + 1
        a = ranked(d.drop("__m"), by, ["__id_"], "__i", "__size", large)
        b = ranked(sims(d.drop("__x", "n", "var")).withColumn("__drawn", drawn), keys, ["__drawn", "__id_"], "__i", "__size", large)
        met = sims(a.drop("__id_", "__size")).join(b.select(*keys, "__m", "__i"), [*keys, "__i"])
    s = met.groupBy(*keys).agg(F.sum(F.col("__m") * F.cos(x)).alias("c"), F.sum(F.col("__m") * F.sin(x)).alias("s"), F.first("n").alias("n"), F.first("var").alias("var"))
    p = s.select(*by, "sim", F.try_divide((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"), F.col("var")).alias("p"))
    # powers of the shuffles of a series are few: they are put beside the true one in its row
    powers = p.groupBy(*by).agg(F.max(F.when(F.col("sim") == 0, F.col("p"))).alias("power"), F.collect_list(F.when(F.col("sim") > 0, F.col("p"))).alias("__all"))
    return powers.select(*by, "power", F.size(F.filter("__all", lambda q: q >= F.col("power"))).cast("bigint").alias("n_above"))
