import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import sphere, text, times, units
from skylattice.functions.bits import BitDictionary
from skylattice.operators import cubes, events, sequence, stats, tables, timeseries


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_nan_becomes_null_once(spark):
    d = tables.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    r = d.agg(F.max("x").alias("m"), F.count("x").alias("n")).first()
    assert (r.m, r.n) == (1.0, 1)


def test_predicate_names_are_not_replaced_inside_words(spark):
    d = spark.createDataFrame([(1, 5), (9, 5)], "mag int, mag1 int")
    assert tables.query(d, "mag>8 & mag1<10").count() == 1


def test_select_rows_keeps_order_repeats_and_missing(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    i = spark.createDataFrame([(1, 2), (2, 2), (3, 9), (4, None)], "pos long, k long")
    assert [r.v for r in tables.select_rows(d, "k", i).orderBy("pos").collect()] == ["b", "b", None, None]


def test_last_range_wins(spark):
    assert one(spark, a=tables.last_range(F.lit(5), [(0, 9), (5, 6), (7, 8)]), b=tables.last_range(F.lit(99), [(0, 9)])) == (2, 0)


def test_bits(spark):
    b = BitDictionary(("a", "b", "c"))
    assert one(spark, x=b.any_set(F.lit(4), "a", "c"), y=b.all_set(F.lit(4), "a", "c"), z=F.array_join(b.names_of(F.lit(5)), "")) == (True, False, "ac")
    with pytest.raises(ValueError):
        b.mask("unknown")


def test_sphere_functions(spark):
    r = one(spark, d=sphere.sphere_dist(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1e-9)), w=sphere.wrap_pi(F.lit(math.pi)), v=sphere.wrap_pi(F.lit(-math.pi)), a=sphere.triangle_area(*[tuple(F.lit(float(x)) for x in v) for v in np.eye(3)]))
    assert r.d >= 0 and r.w == math.pi and r.v == math.pi and abs(r.a - math.pi / 2) < 1e-12
    lon, lat = sphere.to_galactic(F.lit(math.radians(192.85948)), F.lit(math.radians(27.12825)))
    assert abs(one(spark, b=lat).b - math.pi / 2) < 1e-5
    back = sphere.from_galactic(*sphere.to_galactic(F.lit(1.0), F.lit(0.5)))
    assert np.allclose(one(spark, x=back[0], y=back[1]), (1.0, 0.5))
    moved = sphere.move(F.lit(1.0), F.lit(0.2), F.lit(0.3), F.lit(0.7))
    r = one(spark, d=sphere.haversine(F.lit(1.0), F.lit(0.2), *moved), p=sphere.position_angle(F.lit(1.0), F.lit(0.2), *moved))
    assert np.allclose(r, (0.3, 0.7))
    hd = sphere.hadec(*sphere.altaz(F.lit(0.4), F.lit(0.3), 0.5), 0.5)
    assert np.allclose(one(spark, a=hd[0], b=hd[1]), (0.4, 0.3))


def test_times_and_units(spark):
    r = one(spark, j=times.jd(F.lit("2000-01-01 12:00:00").cast("timestamp")), t=times.tt_utc(F.lit(2457754.5)), early=times.tai_utc(F.lit(2400000.5)))
    assert (r.j, r.t, r.early) == (2451545.0, 69.184, None)
    m, d = times.easter(F.lit(2024))
    assert one(spark, m=m, d=d) == (3, 31)
    assert abs(units.unit_factor("km/s", "m*s^-1") - 1000) < 1e-9
    assert abs(one(spark, e=units.photon_energy(F.lit(5000.0), "ang", "ev")).e - 2.47968) < 1e-4


def test_text(spark):
    assert one(spark, n=text.leading_number(F.lit(" 3.5e2abc")), s=text.sexagesimal(F.lit(-12.5)), v=text.from_sexagesimal(F.lit("-12:30:00.000"))) == (350.0, "-12:30:00.000", -12.5)
    assert math.isnan(one(spark, n=text.leading_number(F.lit("x"))).n)
    assert text.snake("camelCaseName") == "camel_case_name" and text.camel("snake_case") == "SnakeCase"


def test_bins_are_open_below(spark):
    d = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (2.5, 4.0)], "x double, y double")
    b = {r.bin: (r.n, r.mean) for r in stats.binning(d, "x", "y", 0.0, 4.0, 1.0, fill=0.0).collect()}
    assert b == {1: (1, 2.0), 2: (1, 3.0), 3: (1, 4.0), 4: (0, 0.0)}


def test_sigma_clip_drops_the_outlier(spark):
    d = spark.createDataFrame([(1, float(v)) for v in [*range(20)] * 5 + [10000]], "k int, v double")
    r = stats.sigma_clip(d, "v", ["k"]).first()
    assert r.n_good == 100 and r.mean == 9.5


def test_wmedian_of_equal_weights(spark):
    d = spark.createDataFrame([(1, float(v), 1.0) for v in (1, 2, 3, 4)] + [(2, 5.0, 1.0), (2, None, 1.0)], "k int, v double, e double")
    assert {r.k: r.wmedian for r in stats.wmedian(d, "v", "e", ["k"]).collect()} == {1: 2.0, 2: 5.0}


def test_running_mean_keeps_its_divisor(spark):
    d = spark.createDataFrame([(1, i, 3.0) for i in range(4)], "k int, i int, v double")
    assert [r.m for r in d.select(sequence.running_mean("v", 1, Window.partitionBy("k").orderBy("i")).alias("m")).collect()] == [2.0, 3.0, 3.0, 2.0]


def test_interpolation_and_constant_series(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, None), (1, 4.0, 8.0), (1, 5.0, None)], "k int, x double, y double")
    assert [r.filled for r in sequence.fill_linear(d, "x", "y", ["k"]).orderBy("x").collect()] == [0.0, 2.0, 8.0, None]
    c = spark.createDataFrame([(1, float(t), 2.0) for t in range(5)], "k int, t double, v double")
    assert sequence.von_neumann(c, "t", "v", ["k"]).first().von_neumann is None
    assert timeseries.periodogram(c, "t", "v", ["k"], [0.1]).first().power is None


def test_periodogram_finds_the_frequency(spark):
    t = np.arange(0, 100, 0.7)
    d = spark.createDataFrame([(1, float(x), float(np.sin(2 * np.pi * 0.12 * x))) for x in t], "k int, t double, v double")
    freqs = [0.05 + 0.01 * i for i in range(15)]
    for f in (timeseries.periodogram, timeseries.scargle):
        assert abs(f(d, "t", "v", ["k"], freqs).orderBy(F.desc("power")).first().freq - 0.12) < 1e-9
    assert abs(timeseries.pdm(d, "t", "v", ["k"], freqs, 8).orderBy("theta").first().freq - 0.12) < 1e-9


def test_orphans_fixture(spark):
    rows = [(s, e) for s in range(2, 6) for e in range(1, 20)] + [(1, 1), (10, 10), (10, 11)]
    d = spark.createDataFrame(rows, "src int, epoch int")
    assert {(r.src, r.n_det) for r in timeseries.orphans(d, "src", "epoch", 3).collect()} == {(1, 1), (10, 2)}


def test_zero_point_recovery(spark):
    d = spark.createDataFrame([(s, e, 10.0 + s + 0.1 * e) for s in range(1, 20) for e in range(5)], "src int, e int, mag double")
    z = {r.e: round(r.zp, 6) for r in timeseries.zero_points(d, "src", "e", "mag", 0).collect()}
    assert z == {e: round(0.1 * e, 6) for e in range(5)}
    zps, means = timeseries.relative_photometry(d, "src", "e", "mag")
    got = {r.e: r.zp for r in zps.collect()}
    assert all(abs(got[e] - got[0] - 0.1 * e) < 1e-6 for e in got)


def test_bad_times(spark):
    d = spark.createDataFrame([(float(t),) for t in range(0, 6000, 10)] + [(3000.0 + 0.01 * k,) for k in range(2000)], "s double")
    bad = events.bad_times(d, "s").collect()
    assert len(bad) == 1 and bad[0].lo <= 3000 <= bad[0].hi
    assert events.bad_times(d.limit(0), "s").count() == 0


def test_image_neighbours(spark):
    im = spark.createDataFrame([(r, c, float(r * c % 5 + (9 if (r, c) == (2, 2) else 0))) for r in range(5) for c in range(5)], "r int, c int, v double")
    assert (2, 2) in {(x.r, x.c) for x in cubes.local_maxima(im).collect()}
    s = cubes.correlate(im, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert s.join(im.withColumnRenamed("v", "w"), ["r", "c"]).where("v <> w").count() == 0


def test_cadence_weight(spark):
    from skylattice.functions.schedule import cadence_weight

    d = spark.createDataFrame([(0, 0.7), (1, 100.0), (2, None), (3, -1000.0)], "id int, w double")
    got = {r.id: r.x for r in d.select("id", cadence_weight(F.col("w")).alias("x")).collect()}
    assert abs(got[0] - 1.1) < 1e-12 and abs(got[1] - 1.0) < 1e-9 and got[2] is None and got[3] == 0


def test_shuffles_are_numbered_in_ranges(spark, monkeypatch):
    from skylattice.operators import significance

    monkeypatch.setattr(significance, "PER_RANGE", 50)
    d = spark.range(1000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sim"))
    h = F.pmod(F.xxhash64("sim", "k", F.lit(5)), F.lit(1 << 40))
    want = {(r.sim, r.k): r.w for r in d.withColumn("w", F.row_number().over(Window.partitionBy("sim").orderBy(h, "k"))).collect()}
    assert {(r.sim, r.k): r["__n"] for r in significance.shuffled_ranks(d, ["sim"], "k", 1000, 5).collect()} == want
    rng = np.random.default_rng(2)
    rows = [(i, float(v), float(v + e), float(e)) for i, (v, e) in enumerate(rng.normal(size=(400, 2)))]
    c = spark.createDataFrame(rows, "k long, x double, y double, z double")
    near, none = (significance.correlation_significance(c, "k", "x", y, 30).first() for y in ("y", "z"))
    assert near.n == 400 and near.prob == 0 and none.prob > 0
