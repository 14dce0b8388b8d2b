"""Queries over whole tables, on sf0.01; no registered text keeps a part of the ids."""

import math
from collections import defaultdict

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from skylattice.queries import ORACLE, QUERIES
from skylattice.registry import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["periodogram", "scargle", "pdm", "phase_entropy", "detrend"])
def test_frequency_queries_over_every_source(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], SF)


def test_string_length_of_every_source_and_frequency(spark):
    from skylattice.plans.series_queries import FREQS

    series = defaultdict(list)
    for source, t, v in connect(SF).sql("SELECT l_suppkey, epoch_us(l_shipdate)/86400000000.0, l_extendedprice FROM lineitem").fetchall():
        series[source].append((t, v))
    got = {(r.source, r.freq): r.length for r in QUERIES["string_length"](spark, SF).collect()}
    assert len(series) > 20 and set(got) == {(s, round(f, 3)) for s in series for f in FREQS}
    for source in (min(series), max(series)):
        for f in (FREQS[0], FREQS[-1]):
            p = sorted((t * f - math.floor(t * f), v) for t, v in series[source])
            want = sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:], strict=False))
            assert math.isclose(got[source, round(f, 3)], want, rel_tol=1e-6)  # the query rounds to a tenth


@pytest.mark.parametrize("name", ["design_matrix", "fold_phase", "indicator_design", "kernel_mean", "structure_function"])
def test_series_queries_over_every_source(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", ["poly_fit", "poly_hypothesis", "harmonic_fit", "fft_power", "savitzky_golay", "ransac_line", "matched_filter"])
def test_fits_return_every_source(spark, name):
    sources = {r[0] for r in connect(SF).sql("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}
    assert len(sources) > 21 and {r.source for r in QUERIES[name](spark, SF).select("source").distinct().collect()} == sources


@pytest.mark.parametrize("name", ["external_orphans", "match_moving", "remove_bad_times", "keyed_insert", "order_history"])
def test_queries_over_every_object(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], SF)


def test_conjunctions_of_every_object(spark):
    at = {}
    for i in [r[0] for r in connect(SF).sql("SELECT s_suppkey FROM supplier").fetchall()]:
        ra, dec = i * 7919 % 36000 / 100.0, i * 104729 % 17000 / 100.0 - 85.0
        for k, (pra, pdec) in enumerate([(0.3, 0.1), (-0.6, 0.4)]):
            at[k, i] = [((ra + pra * t / math.cos(math.radians(dec))) % 360, dec + pdec * t) for t in (0.0, 5.0, 10.0, 15.0, 20.0)]

    def far(p, q):
        (a, b), (c, d) = [tuple(map(math.radians, x)) for x in (p, q)]
        return math.degrees(2 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

    want = {}
    for k, i in at:
        for m, j in at:
            if (k, m) == (0, 1):
                s = [far(p, q) for p, q in zip(at[0, i], at[1, j], strict=True)]
                want |= {(i, j, 5.0 * n): s[n] for n in (1, 2, 3) if s[n] <= 30 and s[n] < s[n - 1] and s[n] < s[n + 1]}
    assert any(i % 5 for i, *_ in want)
    got = {(r.id1, r.id2, r.t): r.dist for r in QUERIES["conjunctions"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=6e-5) for k in want)


EPOCHS = "SELECT l_suppkey AS source, floor(epoch_us(l_shipdate)/86400000000.0/365)::BIGINT AS e, round(avg(25-2.5*log10(l_extendedprice)), 6) AS mag FROM lineitem GROUP BY 1, 2"


def test_zero_points_from_an_epoch_that_is_there(spark):
    assert QUERIES["zp_meddiff"](spark, SF).count() > 0
    compare(spark, QUERIES["zp_meddiff"], ORACLE["zp_meddiff"], SF)


def test_matrix_has_every_epoch(spark):
    want = {(s, str(e)): m for s, e, m in connect(SF).sql(EPOCHS).fetchall()}
    got = {(r.source, c.split(":")[0]): int(c.split(":")[1]) / 1e4 for r in QUERIES["matched2matrix"](spark, SF).collect() for c in r.cells.split(",")}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=6e-5) for k in want)


def test_interpolation_grid_lies_within_the_epochs(spark):
    present = {e for _, e, _ in connect(SF).sql(EPOCHS).fetchall()}
    assert {r.t_new for r in QUERIES["gp_interpolation"](spark, SF).collect()} == {e + 0.5 for e in range(min(present), max(present))}


def test_stream_queries_return_what_batch_returns(spark):
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    assert rows("stream_tumbling") == rows("tumbling_windows")
    batch = table(spark, SF, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    assert rows("stream_sessions") == sorted(tuple(r) for r in batch.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss"), "n").collect())


def test_no_query_keeps_a_subset_of_ids():
    import inspect
    import re

    from skylattice import plans

    for name, sql in ORACLE.items():
        assert not re.search(r"(source|custkey|suppkey|\bid|event_id) *(<=|BETWEEN)|WHERE [a-z_.]*id % \d+ = 0$", sql), name
    folder = inspect.getfile(plans).rsplit("/", 1)[0]
    assert "whole_table" not in "".join(open(f"{folder}/{m}_queries.py").read() for m in ("catalog", "series", "extended", "spatial", "table"))


def test_fits_equal_numpy(spark):
    """Sums against least squares on the rows themselves; the transform and the line against numpy."""
    import numpy as np

    series = defaultdict(list)
    for source, t, v in connect(SF).sql("SELECT l_suppkey, epoch_us(l_shipdate)/86400000000.0, l_extendedprice FROM lineitem").fetchall():
        series[source].append((t, v))
    harmonic = {r.source: r for r in QUERIES["harmonic_fit"](spark, SF).collect()}
    power = defaultdict(dict)
    for r in QUERIES["fft_power"](spark, SF).where("source <= 3").collect():
        power[r.source][round(r.freq, 9)] = r.power
    for source in (1, 2, 3):
        x, y = (np.array(c) for c in zip(*sorted(series[source]), strict=True))
        a = np.column_stack([np.ones(len(x)), *[f(2 * np.pi * 0.05 * k * x) for k in (1, 2) for f in (np.cos, np.sin)]])
        p = np.linalg.lstsq(a, y, rcond=None)[0]
        assert np.allclose(harmonic[source].amplitude, np.hypot(p[1::2], p[2::2]), rtol=1e-6) and np.isclose(harmonic[source].resid_std, np.std(y - a @ p), rtol=1e-8)
        f = np.fft.rfft(y - y.mean())
        assert np.allclose(sorted(power[source].values()), sorted(np.abs(f) ** 2 / len(y) / 1e6), rtol=1e-6, atol=1e-4)


def test_gaussian_process_equals_a_dense_solve(spark):
    import numpy as np

    from skylattice.operators.models import gaussian_process

    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 60, 80))
    y = np.sin(x / 3) + rng.normal(size=80) * 0.01
    d = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 0.0, 5.0)], "k long, t double, v double")
    grid = [3.0, 30.5, 59.0]
    got = {(r.k, r.t_new): r.value for r in gaussian_process(d, "k", "t", "v", grid, 2.0, 0.05).collect()}
    kernel = lambda a, b: y.var() * np.exp(-((a[:, None] - b[None, :]) ** 2) / 8)
    want = y.mean() + kernel(np.array(grid), x) @ np.linalg.solve(kernel(x, x) + 0.0025 * np.eye(80), y - y.mean())
    assert np.allclose([got[1, g] for g in grid], want, atol=5e-3) and got[2, 59.0] == 5.0
