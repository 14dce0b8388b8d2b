"""Registered queries of stored layouts and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from skylattice.operators.spatial import sky
from skylattice.plans import series_queries as series
from skylattice.plans.common import catalog, rounded
from skylattice.plans.spatial_queries import CS, DIST
from skylattice.registry import Registry, table
from skylattice.sources import mesh_store
from skylattice.streaming import events as stream

R = Registry()


def work_dir(spark, label: str) -> str:
    """A new folder that all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="skylattice-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@R.query("zone_store_cone", f"WITH {CS}, z AS (SELECT 300.0 AS ra, 20.0 AS dec) SELECT c.id, round({DIST.format(a='c.', b='z.')}, 6) AS dist FROM c, z WHERE {DIST.format(a='c.', b='z.')} <= 9.0")
def zone_store_cone(spark, d):
    return zone_cone(spark, zone_store(spark, d))


def zone_store(spark, d) -> str:
    """Folder of the customers stored by sky zone."""
    path = work_dir(spark, "zones")
    mesh_store.write_zones(sky(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id"), path, 2.0)
    return path


def zone_cone(spark, path):
    return rounded(mesh_store.read_cone(spark, path, 300.0, 20.0, 9.0, 2.0), "dist").select("id", "dist")


#: Triangles of the mesh, level by level (lvl, id, corners a b c), and whether a position (unit vector v) lies in one.
TRIANGLES = """k(k, v) AS (VALUES (0, [0,0,1]), (1, [1,0,0]), (2, [0,1,0]), (3, [-1,0,0]), (4, [0,-1,0]), (5, [0,0,-1])),
f(id, i, j, l) AS (VALUES (8,1,5,2), (9,2,5,3), (10,3,5,4), (11,4,5,1), (12,1,0,4), (13,4,0,3), (14,3,0,2), (15,2,0,1)),
t AS (SELECT 0 AS lvl, f.id::BIGINT AS id, a.v::DOUBLE[3] AS a, b.v::DOUBLE[3] AS b, c.v::DOUBLE[3] AS c FROM f JOIN k a ON a.k = i JOIN k b ON b.k = j JOIN k c ON c.k = l
  UNION ALL SELECT lvl + 1, id*4 + s, CASE s WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE m0 END, CASE s WHEN 0 THEN m2 WHEN 1 THEN m0 WHEN 2 THEN m1 ELSE m1 END, CASE s WHEN 0 THEN m1 WHEN 1 THEN m2 WHEN 2 THEN m0 ELSE m2 END
  FROM (SELECT *, unit(b, c) AS m0, unit(c, a) AS m1, unit(a, b) AS m2 FROM t WHERE lvl < {level}), (VALUES (0), (1), (2), (3)) w(s))"""
UNIT = "[({a}[1]+{b}[1])/{n}, ({a}[2]+{b}[2])/{n}, ({a}[3]+{b}[3])/{n}]::DOUBLE[3]"


def _triangles(level):
    """TRIANGLES with the middle of an edge written out."""
    out = TRIANGLES.replace("{level}", str(level))
    for a, b in ("bc", "ca", "ab"):
        norm = f"sqrt(({a}[1]+{b}[1])**2 + ({a}[2]+{b}[2])**2 + ({a}[3]+{b}[3])**2)"
        out = out.replace(f"unit({a}, {b})", UNIT.format(a=a, b=b, n=norm))
    return out


IN_TRIANGLE = " AND ".join(f"array_inner_product(array_cross_product({a}, {b}), v) >= -1e-12" for a, b in ("ab", "bc", "ca"))
VECTOR = "[cos(radians(dec))*cos(radians(ra)), cos(radians(dec))*sin(radians(ra)), sin(radians(dec))]::DOUBLE[3] AS v"
#: The triangle of a level of every customer: of those that hold it at all levels the first.
MESH = "WITH RECURSIVE {cs}, {tri}, p AS (SELECT id AS cid, {vector} FROM c), h AS (SELECT cid, lvl, id FROM p, t WHERE {inside}), m AS (SELECT x.cid, min(x.id) AS mesh_id FROM h x WHERE x.lvl = {level} AND {chain} GROUP BY x.cid)\n"


def _mesh_sql(level):
    chain = " AND ".join(f"EXISTS (FROM h y WHERE y.cid = x.cid AND y.lvl = {k} AND y.id = x.id >> {2 * (level - k)})" for k in range(level))
    return MESH.format(cs=CS, tri=_triangles(level), vector=VECTOR, inside=IN_TRIANGLE, level=level, chain=chain)


def _mesh_of(spark, d, level):
    c = sky(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")
    return c.withColumn("mesh_id", mesh_store.mesh_id(F.radians("ra"), F.radians("dec"), level))


@R.query("mesh_index_counts", _mesh_sql(2) + "SELECT mesh_id AS htm_id, count(*) AS n FROM m GROUP BY mesh_id")
def mesh_index_counts(spark, d):
    return _mesh_of(spark, d, 2).groupBy(F.col("mesh_id").alias("htm_id")).agg(F.count("*").alias("n"))


@R.query("mesh_cell_names", _mesh_sql(2) + "SELECT cid AS id, printf('customer_htm_%06d', (mesh_id // 100) * 100) AS file, printf('htm_%06d', mesh_id) AS name FROM m")
def mesh_cell_names(spark, d):
    file, name = mesh_store.cell_names(F.lit("customer"), F.col("mesh_id"))
    return _mesh_of(spark, d, 2).select("id", file.alias("file"), name.alias("name"))


_EDGE = "(array_inner_product(array_cross_product(array_cross_product({a}, {b}), {a}), v) >= -1e-9 AND array_inner_product(array_cross_product({b}, array_cross_product({a}, {b})), v) >= -1e-9 AND abs(array_inner_product(array_cross_product({a}, {b}), v)) <= sin(radians(20)) * sqrt(array_inner_product(array_cross_product({a}, {b}), array_cross_product({a}, {b}))))"
_TOUCH = f"(({IN_TRIANGLE}) OR " + " OR ".join(f"array_inner_product({x}, v) >= cos(radians(20))" for x in "abc") + " OR " + " OR ".join(_EDGE.format(a=a, b=b) for a, b in ("ab", "bc", "ca")) + ")"


@R.query("mesh_cells_of_cone", _mesh_sql(3) + f"SELECT mesh_id, count(*) AS n FROM m WHERE mesh_id IN (SELECT id FROM t, (SELECT {VECTOR} FROM (SELECT 200.5 AS ra, -33.3 AS dec)) WHERE lvl = 3 AND {_TOUCH}) GROUP BY mesh_id")
def mesh_cells_of_cone(spark, d):
    counts = _mesh_of(spark, d, 3).groupBy("mesh_id").agg(F.count("*").alias("n"))
    return mesh_store.cells_of_cone(counts, 200.5, -33.3, 20.0, 3)


def mesh_table(spark, d) -> str:
    """Folder of the customers stored by mesh triangle."""
    path = work_dir(spark, "mesh")
    mesh_store.write_mesh(sky(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id"), path, cells=2)
    return path


@R.query("mesh_cone", f"WITH {CS}, z AS (SELECT 359.0 AS ra, 20.0 AS dec) SELECT c.id, round({DIST.format(a='c.', b='z.')}, 6) AS dist FROM c, z WHERE {DIST.format(a='c.', b='z.')} <= 9.0")
def mesh_cone(spark, d):
    return rounded(mesh_store.read_mesh_cone(spark, mesh_table(spark, d), 359.0, 20.0, 9.0, cells=2), "dist").select("id", "dist")


_STORED = f"WITH {CS}, p AS (SELECT s.id AS probe_id, c.id AS cat_id, {DIST.format(a='s.', b='c.')} AS dist FROM s, c)\n"


@R.query("match_stored", _STORED + "SELECT probe_id, cat_id, round(dist, 6) AS dist FROM p WHERE dist <= 2.5")
def match_stored(spark, d):
    m = mesh_store.match_store(spark, mesh_table(spark, d), catalog(spark, d, "supplier", "s_suppkey"), 2.5, cells=2)
    return rounded(m.withColumnRenamed("id", "cat_id"), "dist")


@R.query("match_stored_nearest", _STORED + "SELECT s.id, cat_id, round(dist, 6) AS dist, coalesce(n_match, 0) AS n_match FROM s LEFT JOIN (SELECT probe_id, arg_min(cat_id, (dist, cat_id)) AS cat_id, min(dist) AS dist, count(*) AS n_match FROM p WHERE dist <= 2.0 GROUP BY probe_id) ON probe_id = s.id")
def match_stored_nearest(spark, d):
    s = catalog(spark, d, "supplier", "s_suppkey")
    m = mesh_store.nearest_stored(spark, mesh_table(spark, d), s, 2.0, cells=2)
    return rounded(s.join(m, s["id"] == m["probe_id"], "left").select("id", "cat_id", "dist", F.coalesce("n_match", F.lit(0)).alias("n_match")), "dist")


def _events(spark, d, files_at_a_time=100):
    path = f"{d}/events.parquet"
    # watermarks take zoned timestamps only
    return stream.table_stream(spark, path, spark.read.parquet(path).schema, files_at_a_time).withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("stream_tumbling", series.ORACLE_TUMBLING)
def stream_tumbling(spark, d, files_at_a_time=100):
    s = stream.tumbling(_events(spark, d, files_at_a_time), "1 hour", None, "event_type")
    out = stream.run_latest(s, ["window", "event_type"], work_dir(spark, "stream"), work_dir(spark, "stream-state"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("w"), "n", F.round("v", 4).alias("v"))


@R.query("stream_sliding", "SELECT event_type, strftime(w, '%Y-%m-%d %H:%M') AS w, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY ALL")
def stream_sliding(spark, d, files_at_a_time=100):
    s = stream.sliding(_events(spark, d, files_at_a_time), "1 hour", "30 minutes", None, "event_type")
    out = stream.run_latest(s, ["window", "event_type"], work_dir(spark, "stream"), work_dir(spark, "stream-state"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("w"), "n")


@R.query("stream_sessions", "WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800000000)::INT, 0) AS new FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS w, count(*) AS n FROM g GROUP BY user_id, g")
def stream_sessions(spark, d, files_at_a_time=100):
    out = stream.run_sessions(_events(spark, d, files_at_a_time), "30 minutes", "user_id", work_dir(spark, "stream"), work_dir(spark, "stream-state"))
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "n")


@R.query("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, d, files_at_a_time=100):
    s = stream.deduplicated(_events(spark, d, files_at_a_time), None, ["event_id"])
    return stream.run_to_end(s, work_dir(spark, "stream"), work_dir(spark, "stream-state")).select("event_id", "user_id", "event_type", "value")


@R.query("stream_visits", "SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_visits(spark, d, files_at_a_time=100):
    out = stream.run_visits(_events(spark, d, files_at_a_time), "user_id", work_dir(spark, "stream"), work_dir(spark, "stream-state"))
    return out.select(F.col("key").alias("user_id"), "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
