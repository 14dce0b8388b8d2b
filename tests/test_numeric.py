"""Fits, transforms, sketches, resampling and shapes against numpy and brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.functions import text
from skylattice.operators import leastsq, movers, resampling, shapes, sketches, transforms


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("const", [True, False])
def test_regression_equals_numpy(spark, const):
    rng = np.random.default_rng(1)
    n = 400
    k, a, b = np.arange(n) % 3, rng.normal(size=n) + (1e6 if const else 3), rng.normal(size=n) * 1e-3
    y, e = 2 * a - 300 * b + k + rng.normal(size=n), rng.uniform(0.5, 2, n)
    d = frame(spark, k=k, a=a, b=b, y=y, e=e).unionByName(spark.createDataFrame([(0, None, 1.0, 1.0, 1.0)], "k long, a double, b double, y double, e double"))
    got = {r.k: r for r in leastsq.regress(d, "k", ["a", "b"], "y", "e", 0.1, const).collect()}
    for g in range(3):
        m = k == g
        x = np.column_stack([a[m], b[m], *([np.ones(m.sum())] if const else [])])
        w = 1 / np.sqrt(e[m] ** 2 + 0.01)
        scale = np.linalg.norm(x * w[:, None], axis=0)
        p = np.linalg.lstsq(x * w[:, None] / scale, y[m] * w, rcond=None)[0] / scale
        r = got[g]
        assert np.allclose(x @ r.par, x @ p, atol=1e-5) and r.n == m.sum() and r.dof == m.sum() - x.shape[1]
        assert np.isclose(r.chi2, (((y[m] - x @ p) * w) ** 2).sum(), rtol=1e-6) and np.isclose(r.std, np.std(y[m] - x @ p, ddof=1), rtol=1e-5) and np.isclose(r.pre_std, np.std(y[m], ddof=1))
        assert np.allclose(r.par_err[1], np.sqrt(np.linalg.inv((x * w[:, None] / scale).T @ (x * w[:, None] / scale))[1, 1]) / scale[1], rtol=1e-4)


def test_regression_of_dependent_terms(spark):
    d = frame(spark, k=[1] * 6, a=[0.0, 1, 2, 3, 4, 5], b=[0.0, 2, 4, 6, 8, 10], c=[7.0] * 6, y=[1.0, 3, 5, 7, 9, 11])
    r = leastsq.regress(d, "k", ["a", "b", "c"], "y").first()
    assert r.dof == 4 and r.chi2 < 1e-9 and abs(r.par[0] + 2 * r.par[1] - 2) < 1e-9
    assert leastsq.regress(d.limit(0), "k", ["a"], "y").count() == 0


@pytest.mark.parametrize(("whole", "small"), [(512, 1 << 18), (0, 1 << 18), (0, 0)])
def test_sparse_system_equals_numpy(spark, monkeypatch, whole, small):
    monkeypatch.setattr(leastsq, "WHOLE", whole)
    monkeypatch.setattr(leastsq, "SMALL", small)
    rng = np.random.default_rng(2)
    rows, stars, images = 150, 12, 6
    s, i = rng.integers(0, stars, rows), rng.integers(0, images, rows)
    m = np.zeros((rows, stars + images - 1))
    m[np.arange(rows), s] = 1.0
    for r in range(rows):
        if i[r]:
            m[r, stars + i[r] - 1] = 0.5
    y, e = m @ rng.normal(size=m.shape[1]) * 10 + rng.normal(size=rows), rng.uniform(0.5, 1.5, rows)
    entries = [(r, f"c{c:02d}", m[r, c]) for r, c in zip(*np.nonzero(m), strict=True)] + [(3, "c00", 0.0), (5, None, 1.0), (9999, "c00", 1.0)]
    rhs = [(r, y[r], e[r]) for r in range(rows)] + [(7777, 1.0, -1.0), (7778, None, 1.0)]
    par, seen = leastsq.sparse_solve(spark.createDataFrame([(int(a), b, float(c)) for a, b, c in entries], "row long, col string, value double"), spark.createDataFrame([(int(a), None if b is None else float(b), float(c)) for a, b, c in rhs], "row long, y double, err double"))
    got = {r["col"]: r for r in par.collect()}
    p = np.linalg.lstsq(m / e[:, None], y / e, rcond=None)[0]
    err = np.sqrt(np.diag(np.linalg.inv((m / e[:, None]).T @ (m / e[:, None]))))
    assert np.allclose([got[f"c{c:02d}"].par for c in range(m.shape[1])], p, atol=1e-6)
    assert np.isclose(seen["chi2"], (((y - m @ p) / e) ** 2).sum(), rtol=1e-8) and seen["dof"] == rows - m.shape[1] and seen["gradient"] <= 1e-9
    assert np.allclose([got[f"c{c:02d}"].par_err for c in range(m.shape[1])], err) if whole else all(r.par_err is None for r in got.values())


@pytest.mark.parametrize(("whole", "small", "wide"), [(512, 1 << 18, 1024), (0, 1 << 18, 1024), (0, 0, 1024), (0, 1 << 18, 1)])
def test_sparse_system_of_rows_measured_several_times(spark, monkeypatch, whole, small, wide):
    for k, v in {"WHOLE": whole, "SMALL": small, "WIDE": wide}.items():
        monkeypatch.setattr(leastsq, k, v)
    m = np.array([[1.0, 0], [1, 2], [0, 3]])
    of, y, e = np.array([0, 0, 1, 1, 1, 2]), np.array([1.0, 3, 4, 5, 9, 2]), np.array([1.0, 2, 1, 0.5, 1, 1])
    entries = spark.createDataFrame([(int(r), f"c{c}", float(m[r, c])) for r, c in zip(*np.nonzero(m), strict=True)], "row long, col string, value double")
    par, seen = leastsq.sparse_solve(entries, spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(of, y, e, strict=True)], "row long, y double, err double"))
    p = np.linalg.lstsq(m[of] / e[:, None], y / e, rcond=None)[0]
    got = {r["col"]: r.par for r in par.collect()}
    assert np.allclose([got["c0"], got["c1"]], p) and np.isclose(seen["chi2"], (((y - m[of] @ p) / e) ** 2).sum()) and seen["dof"] == 4


def test_sparse_fit_takes_every_price_as_one_measurement(spark, monkeypatch):
    import duckdb
    from skylattice.queries import QUERIES

    monkeypatch.setattr(leastsq, "WHOLE", 0)
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT 's' || l_suppkey, 'm' || strftime(l_shipdate, '%Y-%m'), ln(l_extendedprice), 0.1 + l_tax FROM '{sf}/lineitem.parquet'").fetchall()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows} - {min(r[1] for r in rows)})
    m = np.array([[(c in r[:2]) / r[3] for c in names] for r in rows])
    want = dict(zip(names, np.linalg.lstsq(m, np.array([r[2] / r[3] for r in rows]), rcond=None)[0], strict=True))
    got = {r["col"]: r.par for r in QUERIES["sparse_fit"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 2e-6 for c in want)


def shear(image, dy):
    """Sum along one line of the fast transform, by halves."""
    rows, cols = image.shape
    if cols == 1:
        return image[:, 0]
    half = int(dy / 2)
    a, b, gap = shear(image[:, : cols // 2], half), shear(image[:, cols // 2 :], half), dy - half
    out = a.copy()
    for r in range(rows):
        out[r] += b[r + gap] if 0 <= r + gap < rows else 0
    return out


def test_fast_radon_equals_halving_and_finds_a_streak(spark):
    rng = np.random.default_rng(3)
    images = {1: rng.normal(size=(7, 8)), 2: rng.normal(size=(5, 6)), 3: np.ones((3, 1)), 4: rng.normal(size=(33, 32)) * 0.1}
    for c in range(32):  # a line from row 4 that ends 9 rows on
        images[4][4 + round(c * 9 / 31), c] += 1.0
    px = [(k, r, c, float(v)) for k, a in images.items() for (r, c), v in np.ndenumerate(a) if (k, r, c) != (2, 1, 1)]
    images[2][1, 1] = 0.0
    d = spark.createDataFrame([*px, (2, 0, 0, None), (None, 0, 0, 1.0)], "img long, r long, c long, v double")
    got = {}
    for x in transforms.fast_radon(d).collect():
        got.setdefault(x.img, {})[x.dy, x.r] = x.v
    for k, a in images.items():
        wide = 1 << (a.shape[1] - 1).bit_length()
        full = np.pad(a, ((0, 0), (0, wide - a.shape[1])))
        assert set(got[k]) == {(dy, r) for dy in range(1 - wide, wide) for r in range(a.shape[0])}
        for dy in range(1 - wide, wide):
            assert np.allclose([got[k][dy, r] for r in range(a.shape[0])], shear(full, dy))
    assert max(got[4], key=got[4].get) == (9, 4)
    parts = transforms.fast_radon(d.where("img = 1"), partial=True)
    assert {r.level: r.n for r in parts.groupBy("level").agg(F.count_distinct("strip", "dy").alias("n")).collect()} == {0: 8, 1: 12, 2: 14, 3: 15}


def series(spark, sizes, seed=4):
    rng = np.random.default_rng(seed)
    x = {k: rng.normal(size=(n, 2)) for k, n in enumerate(sizes)}
    rows = [(k, float(i) * 0.5, float(a), float(b)) for k, v in x.items() for i, (a, b) in enumerate(v)]
    return x, spark.createDataFrame(rows, "k long, t double, a double, b double").repartition(3)


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_long_transforms_equal_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(transforms, "BLOCK", block)
    x, d = series(spark, [1, 2, 9, 36, 60, 97, 64, 61])
    n = transforms.numbered(d, "k", ["t"], ["a", "b"]).withColumnsRenamed({"a": "re", "b": "im"})
    got = {}
    for r in transforms.fourier(n, "k").collect():
        got.setdefault(r.k, {})[r.i] = complex(r.re, r.im)
    for k, v in x.items():
        assert np.allclose([got[k][i] for i in range(len(v))], np.fft.fft(v[:, 0] + 1j * v[:, 1]))
    c = {}
    for r in transforms.circular_correlation(d, "k", "t", "a", "b").collect():
        c.setdefault(r.k, {})[r.lag] = r["corr"]
    for k, v in x.items():
        if len(v) > 1:
            a, b = v[:, 0] - v[:, 0].mean(), v[:, 1] - v[:, 1].mean()
            want = np.fft.ifft(np.fft.fft(a) * np.conj(np.fft.fft(b))).real / len(v) / a.std(ddof=1) / b.std(ddof=1)
            assert np.allclose([c[k][i] for i in range(len(v))], want)
    p = {}
    for r in transforms.power(d, "k", "t", "a").collect():
        p.setdefault(r.k, {})[round(r.freq, 9)] = r.power
    f = np.fft.rfft(x[5][:, 0] - x[5][:, 0].mean())
    assert np.allclose([p[5][round(q, 9)] for q in np.fft.rfftfreq(97, 0.5)], np.abs(f) ** 2 / 97)


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_lag_sums_with_gaps(spark, block):
    rng = np.random.default_rng(5)
    i = np.sort(rng.choice(300, 150, replace=False)) - 50
    a, b = rng.normal(size=150), rng.normal(size=150)
    a[7] = np.nan
    d = frame(spark, k=[1] * 150, i=i, a=a, b=b).withColumn("a", F.nanvl("a", F.lit(None)))
    got = {r["lag"]: (r.s, r.n) for r in transforms.lag_sums(d, "k", "i", "a", "b", 6, block).collect()}
    for lag in range(-6, 7):
        terms = [a[p] * b[q] for p in range(150) for q in range(150) if i[q] - i[p] == lag and p != 7]
        assert got[lag][1] == len(terms) and np.isclose(got[lag][0], sum(terms))


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([np.exp(rng.normal(size=3000) * 3), -np.exp(rng.normal(size=1000)), np.zeros(50)])
    d = frame(spark, day=np.arange(len(v)) % 7, v=v, u=rng.integers(0, 2000, len(v))).unionByName(spark.createDataFrame([(1, None, 1), (1, float("nan"), 1)], "day long, v double, u long"))
    s = sketches.quantile_sketch(d, "v", ["day"], 0.02)
    for q in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0):
        r = sketches.sketch_quantile(s.withColumn("all_days", F.lit(1)), ["all_days"], q, 0.02).first()
        exact = np.sort(v)[max(0, int(np.ceil(len(v) * q)) - 1)]
        assert r.n == len(v) and abs(r.value - exact) <= 0.0201 * abs(exact) + 1e-12
    assert s.count() < 7 * 1200 and sketches.quantile_sketch(d.limit(0), "v", ["day"]).count() == 0
    n = sketches.distinct_estimate(sketches.distinct_sketch(d, "u", ["day"]).withColumn("g", F.lit(1)), ["g"]).first().n
    assert abs(n - len(set(d.select("u").distinct().toPandas().u))) < 0.08 * 2000


def test_jackknife_equals_leaving_rows_out(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = x + rng.normal(size=60)
    d = frame(spark, k=np.arange(60) % 2, x=x, y=y)
    got = {r.k: r for r in resampling.jackknife(d, ["k"], resampling.correlation_terms(F.col("x"), F.col("y")), resampling.correlation).withColumn("z", resampling.z0(F.col("below"))).collect()}
    for k in (0, 1):
        a, b = x[k::2], y[k::2]
        e = np.array([np.corrcoef(np.delete(a, i), np.delete(b, i))[0, 1] for i in range(30)])
        m, v, r = e.mean(), np.corrcoef(a, b)[0, 1], got[k]
        assert np.isclose(r.value, v) and np.isclose(r.std, np.sqrt(29 / 30 * ((e - m) ** 2).sum())) and np.isclose(r.bias, 29 * (m - v))
        assert np.isclose(r.acceleration, ((m - e) ** 3).sum() / 6 / ((m - e) ** 2).sum() ** 1.5) and np.isclose(r.below, (e < v).mean()) and r.z is not None


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 30, 31])
def test_jackknife_of_the_median(spark, n):
    v = np.random.default_rng(n).integers(0, 9, n).astype(float)
    r = resampling.jackknife_median(frame(spark, k=[1] * n, v=v).unionByName(spark.createDataFrame([(1, None), (2, 5.0)], "k long, v double")), ["k"], "v").collect()
    e = np.array([np.median(np.delete(v, i)) for i in range(n)])
    assert len(r) == 1 and np.isclose(r[0].value, np.median(v)) and np.isclose(r[0]["std"], np.sqrt((n - 1) / n * ((e - e.mean()) ** 2).sum())) and np.isclose(r[0].bias, (n - 1) * (e.mean() - np.median(v)))


def test_bootstrap_deviation(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=2000)
    d = frame(spark, id=np.arange(2000), v=v, k=[1] * 2000)
    mean = lambda s: F.try_divide(s["v"], s["n"])
    b = resampling.bootstrap(d, ["k"], "id", {"n": F.lit(1.0), "v": F.col("v")}, mean, 200)
    r = b.first()
    assert np.isclose(r.value, v.mean()) and abs(r["std"] / (v.std() / np.sqrt(2000)) - 1) < 0.2 and abs(r.bias) < 0.01
    again = resampling.bootstrap(d.repartition(7), ["k"], "id", {"n": F.lit(1.0), "v": F.col("v")}, mean, 200).first()
    assert np.allclose(tuple(r), tuple(again), rtol=1e-9)


def brute_circle(p):
    best = (np.inf, None)
    for k in (1, 2, 3):
        for q in itertools.combinations(p, k):
            c, r, _ = shapes.smallest_circle(np.array(q))
            if r < best[0] and (np.hypot(*(p - c).T) <= r + 1e-9).all():
                best = (r, c)
    return best


def test_enclosing_circles(spark):
    rng = np.random.default_rng(9)
    a = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    groups = {1: rng.normal(size=(30, 2)), 2: np.column_stack([np.cos(a), np.sin(a)]) * 5 + 2, 3: np.array([[1.0, 1.0]] * 4), 4: np.column_stack([np.arange(9.0), np.zeros(9)]), None: rng.uniform(size=(12, 2)) * 1e6}
    rows = [(g, float(x), float(y)) for g, p in groups.items() for x, y in p] + [(1, None, 1.0), (5, None, None)]
    got = {r.g: r for r in shapes.enclosing_circle(spark.createDataFrame(rows, "g long, x double, y double"), "x", "y", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, p in groups.items():
        r, c = brute_circle(p)
        assert np.isclose(got[g].radius, r) and np.allclose([got[g].cx, got[g].cy], c, rtol=1e-6)


def test_gaussian_peak_of_a_histogram(spark):
    rng = np.random.default_rng(10)
    v = np.concatenate([rng.normal(50, 3, 20000), rng.uniform(0, 400, 3000)])
    d = frame(spark, k=[1] * len(v), v=v).unionByName(spark.createDataFrame([(2, 7.0)] * 5 + [(2, None), (3, None)], "k long, v double"))
    got = {r.k: r for r in shapes.mode_fit(d, "v", ["k"]).collect()}
    assert abs(got[1].mode - 50) < 0.2 and abs(got[1]["std"] - 3) < 0.3 and (got[2].mode, got[2].bins) == (7.0, 1) and 3 not in got


def test_tracks_meet_rows_of_any_time(spark):
    rng = np.random.default_rng(11)
    o = pd.DataFrame({"id": np.arange(12), "ra": rng.uniform(0, 20, 12), "dec": rng.uniform(-5, 5, 12), "pm_ra": rng.normal(size=12) * np.tile([0, 1e-4, 0.3, 5.0], 3), "pm_dec": rng.normal(size=12) * np.tile([0, 1e-4, 0.1, 0.5], 3)})
    t = rng.uniform(-3, 3, 600)
    which = rng.integers(0, 12, 600)
    c = pd.DataFrame({"id": np.arange(600), "t": t, "ra": (o.ra[which].to_numpy() + o.pm_ra[which].to_numpy() * t / np.cos(np.radians(o.dec[which].to_numpy())) + rng.normal(size=600) * 0.5) % 360, "dec": o.dec[which].to_numpy() + o.pm_dec[which].to_numpy() * t + rng.normal(size=600) * 0.5})
    got = {(r.obj_id, r.cat_id): r.dist for r in movers.match_tagged(spark.createDataFrame(o), spark.createDataFrame(c), 0.7).collect()}
    want = {}
    for p in o.itertuples():
        ra, dec = np.radians(p.ra + p.pm_ra * c.t / np.cos(np.radians(p.dec))), np.radians(p.dec + p.pm_dec * c.t)
        h = np.sin((np.radians(c.dec) - dec) / 2) ** 2 + np.cos(dec) * np.cos(np.radians(c.dec)) * np.sin((np.radians(c.ra) - ra) / 2) ** 2
        for i in np.flatnonzero(np.degrees(2 * np.arcsin(np.sqrt(h))) <= 0.7):
            want[p.id, int(i)] = np.degrees(2 * np.arcsin(np.sqrt(h[i])))
    assert got.keys() == want.keys() and len(want) > 200 and all(np.isclose(got[k], want[k]) for k in want)
    assert movers.match_tagged(spark.createDataFrame(o), spark.createDataFrame(c).limit(0), 0.7).count() == 0


def test_name_styles_of_columns(spark):
    names = ["RecId", "insertTime", "fDouble", "a_b", "ABC", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.snake_column(F.col("n")).alias("s"), text.camel_column(text.snake_column(F.col("n"))).alias("c")).collect()
    assert [(r.s, r.c) for r in got] == [(text.snake(n), text.camel(text.snake(n))) for n in names]


def test_lag_sums_of_short_series_take_short_transforms(spark, monkeypatch):
    d = spark.createDataFrame([(1, 70_000 + i, float(i), float(i % 3)) for i in range(30)], "k long, i long, a double, b double")
    rows = [(i, float(i), float(i % 3)) for i in range(30)]
    got = {r["lag"]: (r.s, r.n) for r in transforms.lag_sums(d, "k", "i", "a", "b", 6).collect()}
    for lag in range(-6, 7):
        both = [a * rows[i + lag][2] for i, a, _ in rows if 0 <= i + lag < 30]
        assert abs(got[lag][0] - sum(both)) < 1e-6 and got[lag][1] == len(both)
    assert "1 << (block + 4" not in __import__("inspect").getsource(transforms.lag_sums)


def test_nearest_value_looks_back_only(spark):
    from skylattice.operators import sequence

    a = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(60)], "id long, x double")
    b = spark.createDataFrame([(i, float(i * 53 % 97) + i % 2 / 2) for i in range(15)], "key long, x double")
    q = sequence.nearest_value(a, b, "x", 10.0)
    rows = b.collect()
    assert {r.id: r.key for r in q.collect()} == {r.id: min(rows, key=lambda s: (abs(s.x - r.x), s.x, s.key)).key for r in a.collect()}
    # but the frame over the ends of buckets, no frame ends with its group: such frames are summed anew for every row
    assert q._jdf.queryExecution().analyzed().toString().count("unboundedfollowing$()") <= 2
