"""Ranks and quantiles of large groups: both ways give the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import catalogs, groups, models, periods, sequence, significance, stats, timeseries


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    some = [(None if i % 11 == 0 else i % 3, i, r.choice([1.0, 2.5, r.random()])) for i in range(400)]
    return spark.createDataFrame([*some, (1, 900, None), (7, 901, 4.0)], "k long, id long, v double")


def test_ranks(rows, monkeypatch):
    one = {tuple(r) for r in groups.ranked(rows, ["k"], ["v", "id"], "i", "n").collect()}
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    assert {tuple(r) for r in groups.ranked(rows, ["k"], ["v", "id"], "i", "n").collect()} == one and len(one) == 402
    assert groups.ranked(rows.limit(0), ["k"], ["v"], "i", "n").count() == 0


@pytest.mark.parametrize("bound", [10, 1 << 22])
def test_quantiles(rows, monkeypatch, bound):
    monkeypatch.setattr(groups, "GROUP_ROWS", bound)
    got = {r.k: (r.a, r.b, r["__n"]) for r in groups.quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.3}).collect()}
    lists = {}
    for r in rows.where("v is not null").collect():
        lists.setdefault(r.k, []).append(r.v)
    assert set(got) == set(lists)
    for k, v in lists.items():
        assert np.allclose(got[k], (np.quantile(v, 0.5), np.quantile(v, 0.3), len(v)))


def test_operators_with_large_groups(spark, rows, monkeypatch):
    d = rows.where("k is not null and v is not null").withColumn("e", F.col("id") % 4)
    calls = [
        lambda: stats.rmean(d, "v", ["k"]), lambda: stats.binning_npt(d, "v", "id", 7, ["k"]), lambda: stats.median_sparse(d, "v", ["k"], ["id"], 5),
        lambda: significance.adaptive_bins(d, "v", ["k"], 9), lambda: timeseries.zero_points(d, "k", "e", "v", 2), lambda: catalogs.robust_zero_point(d, "v", ["k"], 3.0), lambda: catalogs.residual_outliers(d, "k", "v", 0.5, 3.0).select("id", "outlier"),
    ]
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect())
    small = [plain(c()) for c in calls]
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    assert [plain(c()) for c in calls] == small and all(small)


def test_joins_of_hot_keys(spark):
    d = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (950, "c")], "k long, x string")
    assert groups.spread_join(d, few, "k", F.col("id")).count() == 1801
    assert groups.spread_join(d, few, "k", F.col("id"), "left").count() == 1900


def test_windows_of_large_groups(spark, rows, monkeypatch):
    d = rows.where("k is not null and v is not null").withColumn("x", F.col("id") % 97 + F.col("id") / 1000).withColumn("e", 1 + F.col("id") % 4).withColumn("y", F.col("v") - 0.5)
    calls = [
        lambda: stats.wmedian(d, "v", "e", ["k"]), lambda: catalogs.mode_density(d, "v", ["k"], 12), lambda: catalogs.integral_limits(d, "x", "v", ["k"], 0.9, ["id"]), lambda: catalogs.trapezoid_error(d, "x", "e", ["k"]),
        lambda: sequence.von_neumann(d, "x,id", "v", ["k"]), lambda: sequence.trapezoid(d, "x", "v", ["k"]), lambda: sequence.curve_length(d, "x", "v", ["k"]), lambda: sequence.local_extrema(d, "x", "v", ["k"]), lambda: sequence.zero_crossings(d, "x", "y", ["k"]),
        lambda: models.lag_correlation(d, "k", "x", "v", "y", 12), lambda: models.matched_filter(d, "k", "x", "v", [0, 1, 3, 1, 0]), lambda: periods.shuffled_power(d, "id", "x", "v", ["k"], 0.3, 3),
    ]
    plain = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))) for r in df.fillna(-99).collect())
    small = [plain(c()) for c in calls]
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    for i, c in enumerate(calls):
        assert plain(c()) == small[i], i
    assert all(small)


def test_running_sums(spark, monkeypatch):
    some = [(i % 2, i, None if i < 6 or i % 5 == 0 else float(i)) for i in range(90)] + [(5, 1, None), (None, 1, 2.0), (None, 0, 3.0)]
    d = spark.createDataFrame(some, "k long, id long, v double")
    one = {tuple(r) for r in groups.running(d, ["k"], ["id"], "v", "s", "t").collect()}
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    assert {tuple(r) for r in groups.running(d, ["k"], ["id"], "v", "s", "t").collect()} == one and len(one) == 93


def test_equal_rows_of_a_large_group_spread(spark, monkeypatch):
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    d = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2.0).alias("v"), "id").repartition(8)
    # small ranges are put together at run time otherwise
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert groups._in_ranges(d, ["k"], ["v"]).groupBy("__p").count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = groups.ranked(d, ["k"], ["v"], "i", "n").agg(F.count_distinct("i").alias("c"), F.max("i").alias("m"), F.max("n").alias("n")).first()
    assert tuple(got) == (4000, 4000, 4000)


def test_folded_length_across_slices(spark):
    r = random.Random(5)
    some = [(k, r.uniform(0, 50), r.choice([1.0, 2.0, r.random()])) for k in (1, 2) for _ in range(60)] + [(3, 0.4, 1.0), (4, None, 1.0), (4, 0.1, 2.0), (4, 0.2, None)]
    d = spark.createDataFrame(some, "k long, t double, v double")
    got = {(x.k, x.freq): x.length for x in timeseries.string_length(d, "t", "v", ["k"], [0.01, 0.37]).collect()}
    for k in (1, 2):
        for f in (0.01, 0.37):
            p = sorted((t * f - np.floor(t * f), v) for q, t, v in some if q == k)
            assert np.isclose(got[k, f], sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:])))
    assert len(got) == 8 and got[3, 0.37] is None and got[4, 0.37] is None


def test_copies_of_short_series_are_not_shuffled(spark, monkeypatch):
    from skylattice.operators import groups, periods, timeseries

    d = spark.createDataFrame([(k, float(i * 7 % 31), float(i * i % 13)) for k in range(20) for i in range(40)], "k long, t double, v double")
    runs = {
        "pdm": lambda: timeseries.pdm(d, "t", "v", ["k"], [0.01, 0.37], 8), "entropy": lambda: timeseries.phase_entropy(d, "t", "v", ["k"], [0.01, 0.37], 5),
        "information": lambda: periods.phase_information(d, "t", "v", ["k"], [0.01, 0.37], 6), "length": lambda: timeseries.string_length(d, "t", "v", ["k"], [0.01, 0.37]),
    }
    for run in runs.values():
        q = run()
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "freq" in x]
        few = sorted(map(tuple, q.collect()))
        with monkeypatch.context() as m:
            m.setattr(groups, "GROUP_ROWS", 10)
            many = sorted(map(tuple, run().collect()))
        assert [x[:2] for x in few] == [x[:2] for x in many] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(few, many, strict=True))


def test_shuffles_of_short_series_do_not_shuffle_their_copies(spark, monkeypatch):
    d = spark.createDataFrame([(k if k else None, 1000 * k + i, float(i * 7 % 31), None if i == 5 else float(i * i % 13)) for k in range(12) for i in range(1 if k == 3 else 40)], "k long, id long, t double, v double")
    q = periods.shuffled_power(d, "id", "t", "v", ["k"], 0.3, 4)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "sim" in x]
    rows = lambda q: sorted((r.k, None if r.power is None else round(r.power, 9), r.n_above) for r in q.collect())
    few = rows(q)
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    assert rows(periods.shuffled_power(d, "id", "t", "v", ["k"], 0.3, 4)) == few and len(few) == 11 and few[2] == (3, None, 0)


def test_frames_of_a_parabola_are_not_shuffled(spark, monkeypatch):
    some = [(k, float(i * 7 % 31) + (i % 3) / 10, float(i * i % 13)) for k in (1, 2) for i in range(90)] + [(3, -400.0, 2.0), (3, -398.5, 3.0), (4, 8.0, 5.0), (4, 8.0, 6.0), (4, None, 1.0), (5, -1.5, 0.0), (5, 0.0, 4.0), (5, 1.5, 1.0)]
    d = spark.createDataFrame(some, "k long, t double, v double")
    run = lambda: models.savitzky_golay(d, "k", "t", "v", 3.0)
    plan = run()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for bound in (1 << 22, 10):
        monkeypatch.setattr(groups, "GROUP_ROWS", bound)
        got = {(r.k, r.t): (r.smooth, r.n) for r in run().groupBy("k", "t").agg(F.max("smooth").alias("smooth"), F.count("*").alias("n")).collect()}
        assert sum(n for _, n in got.values()) == len([1 for r in some if r[1] is not None])
        for k, t in got:
            u, v = np.array([((b - t) / 1.5, c) for a, b, c in some if a == k and b is not None and abs(b - t) <= 1.5]).T
            assert abs(np.polyfit(u, v, min(2, len(set(u)) - 1))[-1] - got[k, t][0]) < 1e-6


def test_tasks_of_a_matched_filter_grow_with_its_rows(spark, monkeypatch):
    d = spark.createDataFrame([(k if k else None, float(i * 7 % 31), float(i * i % 13)) for k in range(30) for i in range(40)], "k long, t double, v double")
    run = lambda: models.matched_filter(d, "k", "t", "v", [0, 1, 3, 1, 0])
    rows = lambda q: sorted((r.k, round(r.best, 9), r["at"]) for r in q.collect())
    want = rows(run())
    monkeypatch.setattr(groups, "COPY_ROWS", 100)
    q = run()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(__key" in plan and ", 24)" in plan and "Join" not in plan
    assert rows(q) == want and len(want) == 29
    monkeypatch.setattr(groups, "GROUP_ROWS", 10)
    assert rows(run()) == want
