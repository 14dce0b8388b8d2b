"""Weighted linear least squares: a dense fit in every group, and one sparse system over all rows.

A dense fit needs the sums of products of its terms, which combine before the
shuffle.  A sparse system is kept as a long table (row, col, value) and solved
from the sums of its pairs of columns if it has few, and by conjugate-gradient
steps if it has many; what a step needs of the unknowns is sent out if it is
small, and met by salted joins if not.  Where rows are short the steps go over
the sums of pairs, which are summed once, and not over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.groups import spread_join
from skylattice.operators.models import solved
from skylattice.plans.storage import checkpointed

#: Unknowns (some 40 bytes each) that are sent to every executor, and unknowns whose covariance is solved for whole.
SMALL, WHOLE = 1 << 18, 512
#: Entries of a row, and pairs of columns for each entry of the system, up to which pairs are summed for the steps.
WIDE, PAIRS = 1024, 32


def regress(df: DataFrame, by: str, terms: Sequence[str], y: str, err: str | None = None, sys_err: float = 0.0, const: bool = True) -> DataFrame:
    """Weighted fit of y by terms (and a constant, last) in every group.

    Columns: par, par_err (of the formal covariance), chi2, dof, n, pre_std and
    std (of y and of the residuals).  Errors get sys_err in quadrature; without
    them all weigh the same.  Rows with a missing value, or an error that is
    not positive, are left out.  Where terms depend on each other, the
    parameters are those of the least norm in scaled terms.  Sums are about
    the mean only with a constant; without one chi2 and std lose the digits by
    which y exceeds its residuals.
    """
    sigma = F.lit(1.0) if err is None else F.sqrt(F.pow(F.col(err).cast("double"), F.lit(2)) + sys_err**2)
    d = df.select(F.col(by).alias("__key"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(terms)], F.col(y).cast("double").alias("y"), sigma.alias("s")).dropna().where("s > 0")
    k = len(terms)
    scale = d.groupBy("__key").agg(F.avg("y").alias("ym"), *[x for i in range(k) for x in (F.avg(f"f{i}").alias(f"m{i}"), (F.stddev_pop(f"f{i}") if const else F.sqrt(F.avg(F.col(f"f{i}") * F.col(f"f{i}")))).alias(f"d{i}"))])
    d = d.join(scale, "__key")
    # terms about their mean and by their deviation (size, without a constant), so that the sums lose no digits
    u = [F.coalesce(F.try_divide(F.col(f"f{i}") - (F.col(f"m{i}") if const else F.lit(0.0)), F.col(f"d{i}")), F.lit(0.0)) for i in range(k)] + ([F.lit(1.0)] if const else [])
    v, w = F.col("y") - (F.col("ym") if const else F.lit(0.0)), 1 / (F.col("s") * F.col("s"))
    pairs = [(i, j) for i in range(len(u)) for j in range(i, len(u))]
    sums = [x for i, j in pairs for x in (F.sum(w * u[i] * u[j]).alias(f"a{i}_{j}"), F.sum(u[i] * u[j]).alias(f"b{i}_{j}"))]
    sums += [x for i in range(len(u)) for x in (F.sum(w * u[i] * v).alias(f"h{i}"), F.sum(u[i] * v).alias(f"g{i}"), F.sum(u[i]).alias(f"t{i}"))]
    sums += [F.sum(w * v * v).alias("wyy"), F.sum(v * v).alias("yy"), F.sum(v).alias("y1"), F.count("*").alias("n")]
    s = d.groupBy("__key", "ym", *[f"{c}{i}" for i in range(k) for c in "md"]).agg(*sums)

    size = len(u)

    def fn(r: dict) -> list[dict]:
        n = int(r["n"])
        square = lambda c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        line = lambda c: np.array([r[f"{c}{i}"] for i in range(size)])
        a = square("a")
        cov = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
        p = cov @ line("h")
        # back to the terms as they are
        back = np.eye(size)
        for i in range(k):
            back[i, i] = 1 / r[f"d{i}"] if r[f"d{i}"] else 0.0
            if const:
                back[k, i] = -r[f"m{i}"] * back[i, i]
        par = back @ p
        if const:
            par[k] += r["ym"]
        var = lambda q, one: max(0.0, q - one * one / n) / max(1, n - 1)
        resid = r["yy"] - 2 * p @ line("g") + p @ square("b") @ p
        return [{"par": par.tolist(), "par_err": np.sqrt(np.maximum(0, np.diag(back @ cov @ back.T))).tolist(), "chi2": float(max(0.0, r["wyy"] - p @ line("h"))), "dof": n - int(np.linalg.matrix_rank(a, tol=1e-12 * max(1e-300, np.abs(a).max()), hermitian=True)), "n": n, "pre_std": float(np.sqrt(var(r["yy"], r["y1"]))), "std": float(np.sqrt(var(resid, r["y1"] - p @ line("t"))))}]

    return solved(s, by, fn, "par array<double>, par_err array<double>, chi2 double, dof long, n long, pre_std double, std double")


def _meet(entries: DataFrame, few: DataFrame, n: int, spread: Column | None = None) -> DataFrame:
    """Entries with a value of their column, whatever share of the entries a column has."""
    return entries.join(F.broadcast(few), "col") if n <= SMALL else spread_join(entries, few, "col", F.col("row") if spread is None else spread)


def _total(df: DataFrame, value: Column) -> float:
    return df.agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0]


def _weighted(entries: DataFrame, rhs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Right sides (row, r, and n of equal rows), the scatter of rows that are several, entries with columns of unit length, those lengths and their number."""
    w = rhs.where(F.col("y").isNotNull() & (F.col("err") > 0)).select("row", F.col("y").cast("double").alias("y"), (1 / F.col("err")).cast("double").alias("w"))
    # equal rows are one equation: their mean by weight, and the scatter about it
    weight = F.sum(F.col("w") * F.col("w"))
    mean = w.groupBy("row").agg((F.sum(F.col("w") * F.col("w") * F.col("y")) / weight).alias("ym"), F.sqrt(weight).alias("wm"), F.count("*").alias("n"))
    mean = checkpointed(mean)
    off = F.col("w") * (F.col("y") - F.col("ym"))
    scatter = w.join(mean.where("n > 1").select("row", "ym"), "row").groupBy("row").agg(F.sum(off * off).alias("scatter"))
    a = entries.where(F.col("value").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value"))
    a = checkpointed(a.join(mean.select("row", "wm"), "row").select("row", "col", (F.col("value") * F.col("wm")).alias("value")).where("value <> 0"))
    length = checkpointed(a.groupBy("col").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length")))
    n = length.count()
    a = _meet(a, length, n).select("row", "col", (F.col("value") / F.col("length")).alias("value"))
    a = a if n <= SMALL else checkpointed(a)
    return mean.select("row", (F.col("ym") * F.col("wm")).alias("r"), "n"), scatter, a, length, n


def conjugate_gradients(a: DataFrame, r: DataFrame, n: int, tol: float, most: int) -> tuple[DataFrame, DataFrame, dict]:
    """(col, x), residuals (row, r) and summary of the steps for entries ``a`` with n columns; every vector is written after its step."""
    gradient = lambda r: a.join(r, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("r")).alias("g"))
    g = checkpointed(gradient(r))
    x = g.select("col", F.lit(0.0).alias("x"), F.col("g").alias("p"))
    start = gamma = _total(g, F.col("g") * F.col("g"))
    steps = 0
    while steps < most and gamma > tol * tol * start:
        q = checkpointed(_meet(a, x.select("col", "p"), n).groupBy("row").agg(F.sum(F.col("value") * F.col("p")).alias("q")))
        qq = _total(q, F.col("q") * F.col("q"))
        if not qq > 0:
            break
        alpha = gamma / qq
        r = checkpointed(r.join(q, "row", "left").select("row", (F.col("r") - alpha * F.coalesce("q", F.lit(0.0))).alias("r")))
        g = checkpointed(gradient(r))
        new = _total(g, F.col("g") * F.col("g"))
        x = checkpointed(x.join(g, "col").select("col", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("g") + new / gamma * F.col("p")).alias("p")))
        gamma, steps = new, steps + 1
    return x.select("col", "x"), r, {"steps": steps, "gradient": (gamma / start) ** 0.5 if start else 0.0}


def short_rows(a: DataFrame) -> bool:
    """Whether the pairs of columns that meet in rows are few enough to be summed."""
    s = a.groupBy("row").agg(F.count("*").alias("c")).agg(F.max("c").alias("most"), F.sum("c").alias("entries"), F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).first()
    return (s.most or 0) <= WIDE and (s.pairs or 0) <= PAIRS * (s.entries or 0)


def pair_sums(a: DataFrame) -> DataFrame:
    """(col, other, s): products of the entries of a row, summed over the rows."""
    rows = a.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("e"))
    pairs = rows.select("e", F.explode("e").alias("p")).select("p", F.explode("e").alias("q"))
    return pairs.groupBy(F.col("p.col").alias("col"), F.col("q.col").alias("other")).agg(F.sum(F.col("p.value") * F.col("q.value")).alias("s"))


def pair_gradients(a: DataFrame, r: DataFrame, n: int, tol: float, most: int) -> tuple[DataFrame, DataFrame, dict]:
    """As :func:`conjugate_gradients`, in steps over sums of pairs; residuals of the rows are taken at the end, and steps go on from them until their gradient is small."""
    m = checkpointed(pair_sums(a))
    gradient = lambda r: a.join(r, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("r")).alias("g"))
    g = checkpointed(gradient(r))
    start = seen = _total(g, F.col("g") * F.col("g"))
    x, left, steps = g.select("col", F.lit(0.0).alias("x")), r, 0
    none = F.lit(None).cast("double")
    while steps < most and seen > tol * tol * start:
        # x, gradient g, direction p and its product y, in one table
        v, gamma, first = x.join(g, "col").select("col", "x", "g", F.col("g").alias("p")), seen, steps
        while steps < most and gamma > tol * tol * start:
            met = _meet(m.withColumnsRenamed({"col": "to", "other": "col"}), v.select("col", "p"), n, F.col("to"))
            both = met.select(F.col("to").alias("col"), none.alias("x"), none.alias("g"), none.alias("p"), (F.col("s") * F.col("p")).alias("y")).union(v.select("col", "x", "g", "p", none.alias("y")))
            v = checkpointed(both.groupBy("col").agg(*[F.sum(c).alias(c) for c in "xgpy"]))
            size = _total(v, F.col("p") * F.col("y"))
            if not size > 0:
                break
            alpha = gamma / size
            rest = F.col("g") - alpha * F.col("y")
            new = _total(v, rest * rest)
            v = v.select("col", (F.col("x") + alpha * F.col("p")).alias("x"), rest.alias("g"), (rest + new / gamma * F.col("p")).alias("p"))
            gamma, steps = new, steps + 1
        x = checkpointed(v.select("col", "x"))
        q = _meet(a, x, n).groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("q"))
        left = checkpointed(r.join(q, "row", "left").select("row", (F.col("r") - F.coalesce("q", F.lit(0.0))).alias("r")))
        g = checkpointed(gradient(left))
        before, seen = seen, _total(g, F.col("g") * F.col("g"))
        if steps == first or not seen < before / 4:
            break
    return x, left, {"steps": steps, "gradient": (seen / start) ** 0.5 if start else 0.0}


def whole_system(a: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(col, x, e), residuals and rank from the matrix of all pairs of columns, for few columns."""
    b = a.select("row", F.col("col").alias("other"), F.col("value").alias("times"))
    got = a.join(b, "row").groupBy("col", "other").agg(F.sum(F.col("value") * F.col("times")).alias("s")).collect()
    right = {q["col"]: q["g"] for q in a.join(r, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("r")).alias("g")).collect()}
    names = sorted({q["col"] for q in got})
    place, m = {c: i for i, c in enumerate(names)}, np.zeros((len(names), len(names)))
    for q in got:
        m[place[q["col"]], place[q["other"]]] = q["s"]
    inverse = np.linalg.pinv(m, rcond=1e-10, hermitian=True) if names else m
    x = inverse @ np.array([right[c] for c in names]) if names else []
    e = np.sqrt(np.maximum(0, np.diag(inverse)))
    kind = a.schema["col"].dataType.simpleString()
    out = a.sparkSession.createDataFrame([(c, float(x[i]), float(e[i])) for c, i in place.items()], f"col {kind}, x double, e double")
    q = a.join(F.broadcast(out), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("q"))
    r = r.join(q, "row", "left").select("row", (F.col("r") - F.coalesce("q", F.lit(0.0))).alias("r"))
    return out, r, int(np.linalg.matrix_rank(m, tol=1e-10, hermitian=True)) if names else 0


def sparse_solve(entries: DataFrame, rhs: DataFrame, tol: float = 1e-9, most: int = 300) -> tuple[DataFrame, dict]:
    """Weighted least-squares solution of a sparse system.

    ``entries``: row, col, value (equal places are added); ``rhs``: row, y,
    err (equal rows are measurements of one equation).  Returns (col, par, par_err) and a summary: chi2, dof, steps, and the
    size of the gradient relative to its start.  Rows without a right side or
    with an error that is not positive are left out.  Of a system that does
    not fix its unknowns the solution of least norm in scaled columns is
    returned.

    Up to WHOLE unknowns the matrix of all pairs of columns is summed up and
    solved at once, with its covariance; beyond, conjugate gradients are run
    (over sums of pairs where rows are short) until the gradient is ``tol`` of
    what it was, par_err is null and dof counts all unknowns.
    """
    right, scatter, a, length, n = _weighted(entries, rhs)
    rows, equal = right.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n") > 1, F.lit(False))).first()
    right = right.select("row", "r")
    if n <= WHOLE:
        x, r, rank = whole_system(a, right)
        seen = {"steps": 0, "gradient": 0.0}
    else:
        x, r, seen = (pair_gradients if short_rows(a) else conjugate_gradients)(a, right, n, tol, most)
        x, rank = x.withColumn("e", F.lit(None).cast("double")), n
    par = x.join(length, "col").select("col", (F.col("x") / F.col("length")).alias("par"), (F.col("e") / F.col("length")).alias("par_err"))
    return par, {"chi2": _total(r, F.col("r") * F.col("r")) + (_total(scatter, F.col("scatter")) if equal else 0.0), "dof": rows - rank, **seen}
