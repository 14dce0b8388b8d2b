import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import filenames
from skylattice.operators import imaging, models, significance, transforms
from skylattice.sources import table_store as store


@pytest.fixture
def name(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS t LOCATION '{tmp_path}'")
    spark.sql("USE t")
    yield "stars"
    spark.sql("USE default")
    spark.sql("DROP DATABASE t CASCADE")


def test_table_store(spark, name):
    d = spark.createDataFrame([(1, 1.0, "a"), (2, 12.0, "b")], "id long, mag double, n string").withColumn("part", store.range_partition(F.col("mag"), 10))
    store.create(d, name, ["part"])
    assert store.names(spark) == [name] and set(store.describe(spark, name)) == {"id", "mag", "n", "part"}
    more = spark.createDataFrame([(2, 5.0, 1), (3, None, 2), (3, None, 2)], "id long, mag double, unknown int")
    store.insert(more, name, lambda x: x.withColumn("part", F.lit(0.0)), unique_by=["id"])
    assert [(r.id, r.n) for r in store.select(spark, name, order=["id"]).collect()] == [(1, "a"), (2, "b"), (3, None)]
    store.update(spark, name, F.col("mag") > 10, {"n": F.lit("new")})
    store.delete(spark, name, F.col("mag") < 5)
    assert [(r.id, r.n) for r in store.select(spark, name, ["id", "n"], "id > 0", ["id"], 5).collect()] == [(2, "new"), (3, None)]


def test_csv_of_a_stack(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    store.append_stack([a, b], [{"field": "f1"}, {"field": "f2"}], str(tmp_path / "c"))
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert {(r.x, r.y, r.field) for r in got.collect()} == {("1", None, "f1"), ("2", "3", "f2")}


def test_file_names(spark):
    r = spark.range(1).select(filenames.field(F.lit("/a/P_t_r_f_7_1.fits"), "counter").alias("c"), filenames.field(F.lit("P_t"), "counter").alias("n")).first()
    assert (r.c, r.n) == ("7", None)


def test_tiles_cover_every_pixel(spark):
    px = spark.createDataFrame([(r, c) for r in range(25) for c in range(25)], "r int, c int")
    got = {(x.r, x.c, x.t.tr, x.t.tc) for x in px.withColumn("t", F.explode(imaging.tiles(F.col("r"), F.col("c"), 10, 3))).collect()}
    want = {(r, c, i, j) for r in range(25) for c in range(25) for i in range(4) for j in range(4) if i * 7 <= r < i * 7 + 10 and j * 7 <= c < j * 7 + 10}
    assert got == want


def test_index_round_trip(spark):
    r, c = imaging.subscripts(F.col("id") + 1, 4)
    d = spark.range(12).select(((F.col("id") + 1) == imaging.linear_index(r, c, 4)).alias("ok"))
    assert d.where("not ok").count() == 0


def test_models(spark):
    t = np.arange(0, 20, 0.5)
    d = spark.createDataFrame([(1, float(x), float(3 * x * x - x + 2)) for x in t] + [(2, 1.0, 5.0), (3, None, 1.0)], "k long, t double, v double")
    p = {r.k: r for r in models.polynomial(d, "k", "t", "v", 2).collect()}
    assert set(p) == {1, 2} and abs(p[1].coef[0] - 3) < 1e-6 and p[1].chi2 < 1e-6 and p[2].coef == [5.0]
    s = models.savitzky_golay(d.where("k = 1"), "k", "t", "v", 3.0).orderBy("t").collect()
    assert max(abs(r.smooth - (3 * r.t**2 - r.t + 2)) for r in s) < 1e-6
    line = [(1, x, float(x), float(2 * x + 1)) for x in range(30)] + [(1, 90 + x, float(x) + 0.5, 500.0) for x in range(5)] + [(2, 1, 4.0, 1.0), (2, 2, 4.0, 3.0), (3, 1, None, 1.0)]
    r = {x.k: x for x in models.ransac_line(spark.createDataFrame(line, "k long, id long, t double, v double"), "k", "id", "t", "v", 0.1).collect()}
    assert (round(r[1].slope, 6), round(r[1].intercept, 6), r[1].n_in) == (2.0, 1.0, 30)
    assert set(r) == {1, 2} and (r[2].slope, r[2].intercept, r[2].n_in) == (0.0, 2.0, 2)
    w = transforms.power(spark.createDataFrame([(1, float(x), float(np.sin(2 * np.pi * x / 8))) for x in range(64)], "k long, t double, v double"), "k", "t", "v")
    assert w.orderBy(F.desc("power")).first().freq == 0.125
    a = np.random.default_rng(1).normal(size=(9, 7))
    k = np.arange(9.0).reshape(3, 3)
    pad = np.pad(a, 1)
    assert np.allclose(models.convolve(a, k), [[(pad[i : i + 3, j : j + 3] * k[::-1, ::-1]).sum() for j in range(7)] for i in range(9)])
    assert np.isclose(models.radon(a).sum(1), a.sum()).all()


def test_hash_numbers_are_uniform_and_repeatable(spark):
    u = spark.range(20000).select(significance.uniform(1, "id").alias("u"), significance.normal(3, "id").alias("z"))
    r = u.agg(F.avg("u").alias("m"), F.stddev("z").alias("s"), F.avg("z").alias("zm")).first()
    assert abs(r.m - 0.5) < 0.01 and abs(r.s - 1) < 0.03 and abs(r.zm) < 0.03
    assert u.exceptAll(u).count() == 0


def test_registration_finds_rotation_and_scale(spark):
    import math

    from skylattice.operators.registration import rotation_and_scale

    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (120, 2))
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    c, s = math.cos(math.radians(40)), math.sin(math.radians(40))
    b = spark.createDataFrame([(i, float(1.25 * (c * x - s * y)) + 7, float(1.25 * (s * x + c * y)) - 3) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    r = rotation_and_scale(a, b, 25.0).first()
    assert abs(r.angle - 40) <= 1 and abs(r.scale - 1.25) < 0.03


def test_fields_of_matched_sources(spark, tmp_path):
    from skylattice.sources import matrix_store as ms

    path = str(tmp_path / "m")
    d = spark.createDataFrame([(1, 1, 10.0, 0.1), (1, 2, None, 0.2), (2, 1, 12.0, None)], "source long, e long, mag double, err double")
    ms.write(d, path)
    assert ms.fields(spark, path) == ["err", "mag"]
    ms.add(d.where("source = 1").withColumn("sky", F.col("e") * 2.5), path, "sky")
    ms.add(d.withColumn("mag", F.lit(1.0)), path, "mag")  # in the place of one of the base
    ms.delete(spark, path, "err")
    assert ms.fields(spark, path) == ["mag", "sky"]
    got = ms.read(spark, path, ["sky", "mag"]).orderBy("source", "e").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2.5, 1.0), (1, 2, 5.0, 1.0), (2, 1, None, 1.0)]
    ms.delete(spark, path, "sky")
    with pytest.raises(ValueError, match="sky"):
        ms.read(spark, path, ["sky"])
    plan = ms.read(spark, path, [])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:bigint,e:bigint>" in plan


def test_lines_of_a_database_client(spark, tmp_path):
    from skylattice.sources import text_tables

    (tmp_path / "t.txt").write_text("----\n id | fits_x | v\n----\n 1 | a | 2.5\n 2 |  | x\n(2 rows)\n")
    got = text_tables.read_delimited(spark, str(tmp_path / "t.txt"), text=["fits_"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1.0, "a", 2.5), (2.0, "", None)]
