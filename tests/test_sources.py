import re

import numpy as np
import pytest
from oracle import SF, compare
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.operators.spatial import cone, zone_pairs
from skylattice.queries import ORACLE, QUERIES
from skylattice.sources import fits, mesh_store, text_tables
from skylattice.streaming import events as stream


def test_fits_round_trip(spark, tmp_path):
    image = np.arange(12.0).reshape(3, 4)
    image[1, 2] = np.nan
    (tmp_path / "a.fits").write_bytes(fits.image_bytes(image, {"OBJECT": "M31", "EXPTIME": 3.5}))
    got = {(r.r, r.c): r.v for r in fits.read_images(spark, str(tmp_path)).collect()}
    assert got[2, 3] == 11.0 and got[1, 2] is None and len(got) == 12
    h = {r.key: r.value for r in fits.read_headers(spark, str(tmp_path)).collect()}
    assert h["OBJECT"] == "M31" and float(h["EXPTIME"]) == 3.5
    t = tmp_path / "t"
    t.mkdir()
    (t / "b.fits").write_bytes(fits.table_bytes({"ID": np.array([1, 2]), "RA": np.array([1.5, np.nan]), "NAME": np.array(["x", "yy"])}))
    rows = fits.read_table(spark, str(t)).orderBy("ID").collect()
    assert [(r.ID, r.RA, r.NAME) for r in rows] == [(1, 1.5, "x"), (2, None, "yy")]


def test_text_tables(spark, tmp_path):
    p = tmp_path / "x.tbl"
    p.write_text("\\key = 1\n|ra     |name |n    |\n|double |char |int  |\n 1.5     abc   7    \n null    d     null \n")
    assert [tuple(r) for r in text_tables.read_ipac(spark, str(p)).collect()] == [(1.5, "abc", 7), (None, "d", None)]
    f = tmp_path / "f.txt"
    f.write_text("# c\n  1 2.5xy\n 22 bad z\n")
    assert [tuple(r) for r in text_tables.read_fixed_width(spark, str(f), [("a", 1, 3, "int"), ("b", 4, 4, "double"), ("s", 8, 2, "string")]).collect()] == [(1, 2.5, "xy"), (22, None, "z")]
    h = tmp_path / "h.txt"
    h.write_text("OBJECT  = 'NGC''1' / target\nEXPTIME = 3.5 / s\n")
    assert {r.key: (r.value, r.comment) for r in text_tables.read_header_text(spark, str(h)).collect()} == {"OBJECT": ("NGC'1", "target"), "EXPTIME": ("3.5", "s")}
    assert text_tables.grep(spark, str(h), "3.5").count() == 1


def test_zone_store_prunes_and_agrees(spark, tmp_path):
    d = spark.range(2000).select("id", (F.col("id") * 7919 % 36000 / 100).alias("ra"), (F.col("id") * 104729 % 17000 / 100 - 85).alias("dec"))
    mesh_store.write_zones(d, str(tmp_path / "z"), 2.0, 2)
    got = mesh_store.read_cone(spark, str(tmp_path / "z"), 120.0, 10.0, 12.0, 2.0)
    assert {r.id for r in got.collect()} == {r.id for r in cone(d, 120.0, 10.0, 12.0).collect()}
    assert "PartitionFilters: [zone" in got._jdf.queryExecution().executedPlan().toString()


def test_mesh_ids_cover_the_sphere():
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(0, 2 * np.pi, 5000), np.arcsin(rng.uniform(-1, 1, 5000))
    for level in (0, 3):
        ids = mesh_store.mesh_ids(lon, lat, level)
        assert ids.min() >= 8 * 4**level and ids.max() < 16 * 4**level
        n = np.unique(ids, return_counts=True)[1]
        assert n.max() < 6 * max(1, n.mean())


def test_cover_loses_no_row_and_is_tight():
    rng = np.random.default_rng(6)
    for k in range(300):
        lon, lat = rng.uniform(0, 2 * np.pi), np.arcsin(rng.uniform(-1, 1)) if k % 4 else rng.choice([-np.pi / 2, 0.0, np.pi / 2])
        lon = lon if k % 3 else rng.choice([0.0, np.pi / 2, np.pi])
        radius, level = float(10 ** rng.uniform(-5, 0.3)), int(rng.integers(0, 8))
        # points within the cone, many of them near its edge
        d, a = radius * np.sqrt(rng.uniform(0, 1, 200)) ** 0.2, rng.uniform(0, 2 * np.pi, 200)
        y = np.arcsin(np.clip(np.sin(lat) * np.cos(d) + np.cos(lat) * np.sin(d) * np.cos(a), -1, 1))
        x = lon + np.arctan2(np.sin(a) * np.sin(d) * np.cos(lat), np.cos(d) - np.sin(lat) * np.sin(y))
        ids = mesh_store.mesh_ids(x % (2 * np.pi), y, level)
        for most in (8, 64, 10**6):
            ranges = mesh_store.cone_ranges(lon, lat, radius, level, most)
            assert all(any(lo <= i <= hi for lo, hi in ranges) for i in ids) and len(ranges) <= max(most, 8)
        which, cells = mesh_store.cover(np.array([lon, lon]), np.array([lat, -lat]), np.array([radius, radius]), level)
        assert set(ids) <= set(cells[which == 0]) == {i for lo, hi in ranges for i in range(lo, hi + 1)}
    # a cone much smaller than a triangle touches few of them
    which, cells = mesh_store.cover(rng.uniform(0, 6.28, 500), np.arcsin(rng.uniform(-1, 1, 500)), np.full(500, 1e-4), 5)
    assert len(cells) < 1.2 * 500


def test_mesh_store_reads_what_it_needs(spark, tmp_path):
    d = spark.range(20000).select("id", (F.rand(3) * 360).alias("ra"), F.degrees(F.asin(F.rand(4) * 2 - 1)).alias("dec"))
    d = d.union(spark.createDataFrame([(-1, None, 3.0), (-2, 0.0, 90.0), (-3, 90.0, 0.0), (-4, 180.0, -90.0)], "id long, ra double, dec double")).union(spark.range(30).select(F.col("id") + 50000, F.lit(12.5), F.lit(-3.25)))
    path = str(tmp_path / "m")
    mesh_store.write_mesh(d, path, cells=2)
    stored = spark.read.parquet(path)
    assert stored.count() == 20034
    for ra, dec, r in ((120.0, 10.0, 7.0), (0.0, 90.0, 3.0), (359.9, -2.0, 1.0), (12.5, -3.25, 0.01), (45.0, 45.0, 0.0), (10.0, 0.0, 170.0)):
        got = mesh_store.read_mesh_cone(spark, path, ra, dec, r, cells=2)
        # the latitude band of cone() is right for all radii
        assert {x.id for x in got.collect()} == {x.id for x in cone(d, ra, dec, r).collect()}
    small = mesh_store.read_mesh_cone(spark, path, 120.0, 10.0, 2.0, cells=2)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*mesh_cell#\d+ (=|IN)", plan) and "GreaterThanOrEqual(mesh_id" in plan
    probes = d.where("id % 997 = 0 or id < 0 or id > 50000").unionByName(d.where("id = 997"))
    got = mesh_store.match_store(spark, path, probes, 1.5, cells=2)
    want = zone_pairs(probes, d, 1.5)
    key = lambda x, b: sorted((r.probe_id, r[b], round(r.dist, 9)) for r in x.collect())
    assert key(got, "id") == key(want, "cat_id") and len(key(got, "id")) > 900
    few = mesh_store.match_store(spark, path, probes.where("id = 997").limit(1), 0.5, cells=2)
    assert re.search(r"PartitionFilters: \[[^]]*mesh_cell#\d+ (=|IN)", few._jdf.queryExecution().executedPlan().toString())
    assert mesh_store.match_store(spark, path, probes.limit(0), 0.5, cells=2).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", ("a", "b")[i % 2], float(i)) for i in range(200)] + [(999, "2024-01-03 00:00:00", "a", 0.0)]
    d = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    schema = T.StructType(d.schema.fields)
    s = stream.tumbling(stream.folder_stream(spark, str(tmp_path / "in"), schema), "10 minutes", "1 minute", "event_type")
    out = stream.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = stream.tumbling(d, "10 minutes", "1 minute", "event_type").where("window.end <= '2024-01-02'")
    key = lambda x: sorted((str(r.window.start), r.event_type, r.n, r.v) for r in x.collect())
    assert key(out) == key(batch)


def test_whole_stream_equals_unfiltered_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    rows = lambda day, n: [(i, f"{day} 00:{i % 60:02d}:00", ("a", "b")[i % 2], float(i)) for i in range(n)]
    for day in ("2024-01-03", "2024-01-01"):  # the second file is earlier by days
        d = spark.createDataFrame(rows(day, 200), "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    d = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    key = lambda x: sorted((str(r.window.start), str(r.window.end), r.event_type, r.n) for r in x.collect())
    files = lambda: stream.folder_stream(spark, str(tmp_path / "in"), d.schema, files_at_a_time=1)
    paths = lambda k: (str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}"))
    for k, f in enumerate((lambda x: stream.tumbling(x, "10 minutes", None, "event_type"), lambda x: stream.sliding(x, "10 minutes", "5 minutes", None, "event_type"))):
        out = stream.run_latest(f(files()), ["window", "event_type"], *paths(k))
        assert key(out) == key(f(d)) and out.count() > 0
    out = stream.run_sessions(files(), "5 minutes", "event_type", *paths("s"))
    assert key(out) == key(stream.sessions(d, "5 minutes", None, "event_type")) and out.count() > 0


@pytest.fixture(scope="module")
def split_tables(spark, tmp_path_factory):
    """The tables with events as one file and as six part files that are out of order of time."""
    one, many = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("many")
    e = spark.read.parquet(f"{SF}/events.parquet")
    (one / "events.parquet").symlink_to(f"{SF}/events.parquet")
    for k, share in enumerate((5, 2, 0, 4, 1, 3)):
        rows = e.withColumn("place", F.percent_rank().over(Window.orderBy("ts"))).where(F.floor(F.col("place") * 5.999) == share).drop("place")
        rows.unionByName(rows.limit(3) if k % 2 else rows.limit(0)).coalesce(1).write.mode("append").parquet(str(many / "events.parquet"))
    return str(one), str(many)


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_sessions", "stream_dedup", "stream_visits", "stream_ingest"])
def test_streams_over_part_files_out_of_order(spark, split_tables, name):
    one, many = split_tables
    f, sql = QUERIES[name], ORACLE[name]
    compare(spark, f, sql, one, ["events"])
    compare(spark, lambda s, d: f(s, d, files_at_a_time=1), sql, many, ["events"])


def test_visits_go_on_from_the_checkpoint(spark, tmp_path):
    rows = lambda ids, day: spark.createDataFrame([(i, f"2024-01-{day:02d} 00:00:00") for i in ids], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    schema = rows([1], 1).schema
    for n, (ids, day) in enumerate((([1, 1, 2], 5), ([2, 3, None], 2), ([1, 4], 9))):
        rows(ids, day).write.mode("append").parquet(str(tmp_path / "in"))
        s = stream.folder_stream(spark, str(tmp_path / "in"), schema)  # started anew after every file
        out = {r.key: (r.n, r["first"].day, r["last"].day) for r in stream.run_visits(s, "user_id", str(tmp_path / "out"), str(tmp_path / "ck")).collect()}
        assert len(out) == (2, 3, 4)[n]
    assert out == {1: (3, 5, 9), 2: (2, 2, 5), 3: (1, 2, 2), 4: (1, 9, 9)}


def test_idle_visits_end_by_timer(spark, tmp_path):
    at = lambda ids, ts: spark.createDataFrame([(i, ts) for i in ids], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        for ids, ts in (([1, 2], "2024-01-01 00:00:00"), ([2], "2024-01-01 03:00:00"), ([2], "2024-01-01 03:10:00"), ([1], "2024-01-01 03:20:00")):
            at(ids, ts).write.mode("append").parquet(str(tmp_path / "in"))
            s = stream.visits(stream.folder_stream(spark, str(tmp_path / "in"), at([1], ts).schema), "user_id", ("0 seconds", 3_600_000))
            stream.ingest(s, lambda b, _: seen.extend((r.key, r.n, r.ended) for r in b.collect()), str(tmp_path / "ck"), "update")
    finally:
        spark.conf.set(name, before)
    assert (1, 1, True) in seen and seen.count((1, 1, False)) == 2 and (2, 3, False) in seen


def test_ingest_processes_each_file_once(spark, tmp_path):
    d = spark.range(10).withColumn("ts", F.current_timestamp())
    d.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        stream.ingest(stream.folder_stream(spark, str(tmp_path / "in"), d.schema), lambda b, _: seen.append(b.count()), str(tmp_path / "ck"))
    assert sum(seen) == 10


def unit(cards, data=b""):
    return fits.padded(b"".join(fits.card(k, v) for k, v in cards) + b"END".ljust(fits.CARD), b" ") + fits.padded(data)


def test_table_after_a_large_image_with_scaled_and_variable_columns(spark, tmp_path):
    """A primary image of 200 x 200 doubles; unsigned, scaled, null, bit, complex and variable-length columns."""
    image = np.arange(40000.0).reshape(200, 200)
    kinds = [("U", "1I", ">i2"), ("S", "1J", ">i4"), ("N", "1I", ">i2"), ("B", "10X", ("u1", (2,))), ("C", "1C", ">c8"), ("P", "1PD(3)", (">i4", (2,))), ("T", "4A", "S4"), ("L", "1L", "S1"), ("K", "1K", ">i8")]
    a = np.zeros(2, np.dtype([(n, *((k,) if isinstance(k, str) else k)) for n, _, k in kinds]))
    a["U"], a["S"], a["N"] = [-32768, 32767], [10, 20], [7, -99]
    a["B"], a["C"], a["P"] = [[0b10100000, 0b01000000], [255, 255]], [1 + 2j, 3 - 4j], [[3, 0], [1, 24]]
    a["T"], a["L"], a["K"] = [b"ab", b"wxyz"], [b"T", b"F"], [-(1 << 63), (1 << 63) - 1]
    heap = np.array([1.5, 2.5, 3.5, 4.5], ">f8").tobytes()
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", a.dtype.itemsize), ("NAXIS2", 2), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(kinds))]
    for i, (n, form, _) in enumerate(kinds, 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", form)]
    cards += [("TZERO1", 32768), ("TSCAL2", 0.5), ("TZERO2", 100.0), ("TNULL3", -99), ("TZERO9", 1 << 63)]
    (tmp_path / "a.fits").write_bytes(fits.image_bytes(image) + unit(cards, a.tobytes() + heap))
    r = fits.read_table(spark, str(tmp_path)).orderBy("U").collect()
    assert [x.U for x in r] == [0, 65535] and [x.S for x in r] == [105.0, 110.0] and [x.N for x in r] == [7, None]
    assert r[0].B == [True, False, True, False, False, False, False, False, False, True] and r[1].B == [True] * 10
    assert [x.C for x in r] == [[1.0, 2.0], [3.0, -4.0]] and [x.P for x in r] == [[1.5, 2.5, 3.5], [4.5]]
    assert [x["T"] for x in r] == ["ab", "wxyz"] and [x.L for x in r] == [True, False] and [int(x.K) for x in r] == [0, 2**64 - 1]
    assert fits.parse_card("KEY     = 'not closed") == ("KEY", "not closed", "")


def test_nearest_rows_of_a_mesh_store_by_place(spark, tmp_path):
    import math

    from skylattice.sources import mesh_store

    at = [(10.0, 20.0), (10.1, 20.0), (11.9, 20.0), (359.9, -5.0), (0.4, -5.0), (77.0, 89.5), (257.0, 89.9), (150.0, 40.0)]
    rows = [(i, *at[i * 5 % 8]) for i in range(40)] + [(90, None, 1.0)]
    probes = [(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 10.04, 20.0), (4, 0.0, -5.0), (5, 80.0, 89.9), (6, 200.0, 0.0), (7, 13.7, 20.0), (8, None, None), (9, 10.0, 18.3)]
    stars, asked = spark.createDataFrame(rows, "id long, ra double, dec double"), spark.createDataFrame(probes, "id long, ra double, dec double")
    mesh_store.write_mesh(stars, str(tmp_path / "m"), cells=2)
    q = mesh_store.nearest_stored(spark, str(tmp_path / "m"), asked, 2.0, cells=2)

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.degrees(2 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

    want = {}
    for i, ra, dec in probes:
        near = sorted((round(far(ra, dec, c, d), 9), k) for k, c, d in rows if None not in (ra, c) and far(ra, dec, c, d) <= 2.0)
        if near:
            want[i] = (near[0][1], near[0][0], len(near))
    assert set(want) == {1, 2, 3, 4, 5, 7, 9} and {r.probe_id: (r.cat_id, round(r.dist, 9), r.n_match) for r in q.collect()} == want
    # pairs of the whole circle are hashed, and none is sorted where a place has a partner close by
    plan = mesh_store.nearest_stored(spark, str(tmp_path / "m"), asked.where("id <= 2"), 2.0, cells=2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert any("HashAggregate" in x and "sum(n#" in x and "SortAggregate" not in x for x in text.splitlines())
    assert [r.n_match for r in plan.collect()] == [want[1][2]] * 2
