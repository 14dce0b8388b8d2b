"""Smallest enclosing circles and Gaussian peaks: small numeric steps on what Spark has summed up."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.plans.storage import checkpointed

#: A point is outside a circle beyond this share of its radius.
SLACK = 1e-11


def smallest_circle(p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Centre, radius and the (at most three) points on it of the smallest circle around a few points."""
    best = (p[0], 0.0, p[:1])
    holds = lambda c, r: (np.hypot(*(p - c).T) <= r * (1 + SLACK) + 1e-300).all()
    if len(p) == 1 or holds(*best[:2]):
        return best
    for two in itertools.combinations(range(len(p)), 2):
        a, b = p[list(two)]
        c, r = (a + b) / 2, float(np.hypot(*(a - b))) / 2
        if holds(c, r):
            return c, r, p[list(two)]
    best = (p[0], np.inf, p[:1])
    for three in itertools.combinations(range(len(p)), 3):
        a, b, c = p[list(three)]
        d = 2 * np.linalg.det([b - a, c - a])
        if d:
            u = np.array([(c - a)[1] * ((b - a) ** 2).sum() - (b - a)[1] * ((c - a) ** 2).sum(), (b - a)[0] * ((c - a) ** 2).sum() - (c - a)[0] * ((b - a) ** 2).sum()]) / d
            r = float(np.hypot(*u))
            if r < best[1] and holds(a + u, r):
                best = (a + u, r, p[list(three)])
    return best


def enclosing_circle(df: DataFrame, x: str, y: str, by: Sequence[str], most: int = 100) -> DataFrame:
    """Smallest circle around the points of every group: (by, cx, cy, radius).

    From a circle around few points, the point farthest outside is found by an
    aggregation and the smallest circle of those that carry it and that point
    is taken, until none is outside; the radius grows at every step, so this
    ends, as a rule after some ten.  Points with a missing coordinate are left out.
    """
    d = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)")
    keys = [f"__k{i}" for i in range(len(by))]
    point = F.struct("__x", "__y")
    state = d.groupBy(*by).agg(F.min(point).alias("p")).select(*by, F.col("p.__x").alias("cx"), F.col("p.__y").alias("cy"), F.lit(0.0).alias("radius"), F.array("p").alias("on"))
    state = checkpointed(state)
    schema = state.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for i in g.index[g["far"].notna()]:
                c, r, on = smallest_circle(np.array([[q["__x"], q["__y"]] for q in [*g.at[i, "on"], g.at[i, "far"]]]))
                g.at[i, "cx"], g.at[i, "cy"], g.at[i, "radius"], g.at[i, "on"] = float(c[0]), float(c[1]), float(r), [{"__x": float(a), "__y": float(b)} for a, b in on]
            yield g[[f.name for f in schema]]

    for _ in range(most):
        s = state.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "cx", "cy", "radius")
        same = F.lit(True)
        for c, k in zip(by, keys, strict=True):
            same = same & d[c].eqNullSafe(F.col(k))
        off = F.hypot(F.col("__x") - F.col("cx"), F.col("__y") - F.col("cy"))
        out = d.join(s, same).withColumn("__off", off).where(F.col("__off") > F.col("radius") * (1 + 10 * SLACK)).groupBy(*keys).agg(F.max_by(point, F.struct("__off", "__x", "__y")).alias("far"))
        out = checkpointed(out)
        if not out.limit(1).count():
            break
        same = F.lit(True)
        for c, k in zip(by, keys, strict=True):
            same = same & state[c].eqNullSafe(out[k])
        state = checkpointed(state.join(out, same, "left").select(*state.columns, "far").mapInPandas(run, schema))
    return state.select(*by, "cx", "cy", "radius")


def gaussian_peak(x: np.ndarray, n: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Height, centre and width of a Gaussian fitted to counts, by damped Gauss-Newton steps from the fullest bin."""
    w = max(np.sqrt(max(0.0, np.average((x - np.average(x, weights=n)) ** 2, weights=n))), (x[-1] - x[0]) / max(1, len(x)) / 2, 1e-300)
    p = np.array([n.max(), x[n.argmax()], w])
    model = lambda p: p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)
    damp, cost = 1e-3, ((n - model(p)) ** 2).sum()
    for _ in range(steps):
        f = model(p)
        j = np.column_stack([f / p[0], f * (x - p[1]) / p[2] ** 2, f * (x - p[1]) ** 2 / p[2] ** 3])
        a, g = j.T @ j, j.T @ (n - f)
        trial = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-300), g, rcond=None)[0]
        trial[2] = abs(trial[2])
        new = ((n - model(trial)) ** 2).sum() if trial[0] > 0 and trial[2] > 0 else np.inf
        if new < cost:
            done = cost - new < 1e-12 * cost
            p, cost, damp = trial, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), float(p[2])


def mode_fit(df: DataFrame, value: str, by: Sequence[str], per_bin: int = 100, low: float = 0.025, high: float = 0.9, most_bins: int = 1000) -> DataFrame:
    """Mode and width of every group from a Gaussian fitted to its histogram: (by, mode, std, bins).

    The histogram covers the values between two quantiles, in bins of about
    ``per_bin`` values (at least 5 and at most ``most_bins`` bins).  Where the
    fit leaves that range, the fullest bin and the root of its count stand in,
    as where all values are one.
    """
    from skylattice.operators.groups import quantiles

    d = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    q = quantiles(d, list(by), "__v", {"__lo": low, "__hi": high})
    j = d.join(q, list(by)).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    bins = F.least(F.lit(most_bins), F.greatest(F.lit(5), F.floor(F.col("__n") * (high - low) / per_bin)))
    step = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins)
    j = j.withColumn("__step", step).withColumn("__b", F.coalesce(F.least(bins - 1, F.floor((F.col("__v") - F.col("__lo")) / step)), F.lit(0)).cast("int"))
    h = j.groupBy(*by, "__lo", "__hi", "__step", "__b").agg(F.count("*").alias("__c")).groupBy(*by, "__lo", "__hi", "__step").agg(F.collect_list(F.struct("__b", "__c")).alias("__h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for lo, hi, width, hist in zip(g["__lo"], g["__hi"], g["__step"], g["__h"], strict=True):
                count = np.zeros(max(x["__b"] for x in hist) + 1)
                for x in hist:
                    count[x["__b"]] = x["__c"]
                if width is None or not width > 0:
                    rows.append((lo, float(np.sqrt(count.max())), 1))
                    continue
                x = lo + (np.arange(len(count)) + 0.5) * width
                _, mode, std = gaussian_peak(x, count)
                rows.append((mode, std, len(count)) if lo <= mode <= hi else (float(x[count.argmax()]), float(np.sqrt(count.max())), len(count)))
            out = g[list(by)].reset_index(drop=True)
            yield out.join(pd.DataFrame(rows, columns=["mode", "std", "bins"]))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return h.mapInPandas(run, f"{kinds}, mode double, std double, bins long")
