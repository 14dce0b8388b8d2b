"""Jackknife and bootstrap of any estimator that is a function of sums, and of the median.

What is left when a row is taken away is the sums of its group less its own
terms, so every leave-one-out estimate is a projection; a resample is a sum of
the terms with Poisson weights.  No group is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.groups import ranked

Sums = dict[str, Column]

#: Modulus and factor of the draw: a product of two numbers below the modulus is a 64-bit integer.
PRIME, FACTOR = 2147483647, 1103515245


def correlation(s: Sums) -> Column:
    """Pearson correlation from n, x, y, xx, yy, xy."""
    n = s["n"]
    return F.try_divide(n * s["xy"] - s["x"] * s["y"], F.sqrt((n * s["xx"] - s["x"] * s["x"]) * (n * s["yy"] - s["y"] * s["y"])))


def correlation_terms(x: Column, y: Column) -> Sums:
    return {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}


def _summary(left_out: DataFrame, by: Sequence[str]) -> DataFrame:
    """From estimates with each row left out (``__e``) and of all rows (``__all``): see jackknife."""
    m = left_out.groupBy(*by).agg(F.avg("__e").alias("__m"))
    d = left_out.join(m, list(by)).withColumn("__d", F.col("__m") - F.col("__e"))
    n = F.col("n")
    a = d.groupBy(*by).agg(F.first("__all").alias("value"), F.first("__m").alias("__m"), F.count("__e").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("s2"), F.sum(F.pow("__d", F.lit(3))).alias("s3"), F.avg((F.col("__e") < F.col("__all")).cast("double")).alias("below"))
    return a.select(*by, "value", F.sqrt((n - 1) / n * F.col("s2")).alias("std"), ((n - 1) * (F.col("__m") - F.col("value"))).alias("bias"), F.coalesce(F.try_divide(F.col("s3"), 6 * F.pow("s2", F.lit(1.5))), F.lit(0.0)).alias("acceleration"), "below", "n")


def jackknife(df: DataFrame, by: Sequence[str], terms: Sums, estimator: Callable[[Sums], Column]) -> DataFrame:
    """Leave-one-out error of a function of sums of terms: value, std, bias, acceleration, below, n.

    ``below`` is the share of estimates under the value, which ``z0`` turns
    into the bias correction of an interval.  Rows with a missing term are
    left out; a group of one row has no estimate and is left out as well.
    """
    d = df.select(*by, *[c.cast("double").alias(f"__t_{k}") for k, c in terms.items()]).dropna(subset=[f"__t_{k}" for k in terms])
    s = d.groupBy(*by).agg(*[F.sum(f"__t_{k}").alias(f"__s_{k}") for k in terms])
    j = d.join(s, list(by))
    one = estimator({k: F.col(f"__s_{k}") - F.col(f"__t_{k}") for k in terms})
    return _summary(j.select(*by, one.alias("__e"), estimator({k: F.col(f"__s_{k}") for k in terms}).alias("__all")), by)


def jackknife_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """As jackknife, for the median: with a row left out it is a value, or the mean of two, next to the middle of its group."""
    r = ranked(df.where(F.col(value).isNotNull()).select(*by, value), list(by), [value], "__i", "__n").where("__n > 1")
    near = F.abs(2 * F.col("__i") - F.col("__n") - 1) <= 3
    m = r.where(near).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__i", F.col(value).cast("double")))).alias("__m"))
    at = lambda k: F.try_element_at(F.col("__m"), k.cast("bigint"))
    n, i = F.col("__n"), F.col("__i")
    middle = lambda k, size: F.when(size % 2 == 1, at(k((size + 1) / 2))).otherwise((at(k(size / 2)) + at(k(size / 2 + 1))) / 2)
    skip = lambda k: F.when(F.floor(k) >= i, F.floor(k) + 1).otherwise(F.floor(k))
    j = r.join(m, list(by))
    return _summary(j.select(*by, middle(skip, n - 1).alias("__e"), middle(lambda k: F.floor(k), n).alias("__all")), by)


def z0(below: Column) -> Column:
    """Bias correction from the share of estimates below the value; infinite shares are null."""

    @F.pandas_udf("double")
    def inverse(p: pd.Series) -> pd.Series:
        normal = NormalDist()
        return p.map(lambda x: normal.inv_cdf(x) if x is not None and 0 < x < 1 else None)

    return inverse(below)


def draw(key: Column, sim: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from integer arithmetic on a key, the number of a simulation and a seed: the same on every machine."""
    a = F.pmod(key * 7919 + sim * 104729 + seed * 1299709, F.lit(PRIME))
    b = (a * FACTOR + 12345) % PRIME
    return ((b * FACTOR + 54321) % PRIME + 0.5) / PRIME


def draw_sql(key: str, sim: str, seed: int = 0) -> str:
    """The same as SQL text."""
    a = f"(({key}*7919 + {sim}*104729 + {seed * 1299709}) % {PRIME})"
    return f"(((({a}*{FACTOR} + 12345) % {PRIME})*{FACTOR} + 54321) % {PRIME} + 0.5)/{PRIME}"


def _poisson_steps() -> list[float]:
    """Shares at which a Poisson weight of mean 1 goes up by one."""
    mass, total, out = 0.36787944117144233, 0.0, []
    for k in range(1, 9):
        total += mass
        out.append(total)
        mass /= k
    return out


def poisson_weight(key: Column, sim: Column) -> Column:
    """A weight with mean 1 for a row in a simulation."""
    u, weight = draw(key, sim), F.lit(0)
    for k, share in enumerate(_poisson_steps(), 1):
        weight = F.when(u > share, F.lit(k)).otherwise(weight)
    return weight


def weight_sql(key: str, sim: str) -> str:
    return "(" + " + ".join(f"({draw_sql(key, sim)} > {x!r})::INT" for x in _poisson_steps()) + ")"


def normal_draw(key: Column, sim: Column, seed: int = 1) -> Column:
    """A standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.log(draw(key, sim, seed))) * F.cos(6.283185307179586 * draw(key, sim, seed + 1))


def bootstrap(df: DataFrame, by: Sequence[str], key: str, terms: Sums, estimator: Callable[[Sums], Column], n_sim: int) -> DataFrame:
    """Mean and deviation of an estimator over Poisson resamples: value, mean, std, bias.  ``key`` is an integer id of a row."""
    d = df.select(*by, F.col(key).cast("bigint").alias("__key"), *[c.cast("double").alias(f"__t_{k}") for k, c in terms.items()]).dropna(subset=["__key", *[f"__t_{k}" for k in terms]])
    sims = d.withColumn("__sim", F.explode(F.sequence(F.lit(0), F.lit(n_sim))))
    weight = F.when(F.col("__sim") == 0, 1).otherwise(poisson_weight(F.col("__key"), F.col("__sim")))
    s = sims.withColumn("__w", weight).groupBy(*by, "__sim").agg(*[F.sum(F.col(f"__t_{k}") * F.col("__w")).alias(f"__t_{k}") for k in terms])
    e = s.select(*by, "__sim", estimator({k: F.col(f"__t_{k}") for k in terms}).alias("__e"))
    drawn = F.when(F.col("__sim") > 0, F.col("__e"))
    out = e.groupBy(*by).agg(F.max(F.when(F.col("__sim") == 0, F.col("__e"))).alias("value"), F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("std"))
    return out.withColumn("bias", F.col("mean") - F.col("value"))
