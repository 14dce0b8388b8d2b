"""Registered queries of files, stores by field, and series that other modules lack."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skylattice.operators import transforms
from skylattice.operators.groups import ranked
from skylattice.plans.common import day, rounded
from skylattice.plans.numeric_queries import MONTHS, PX, _months
from skylattice.plans.source_queries import _events, work_dir, zone_store
from skylattice.plans.spatial_queries import SKY
from skylattice.plans.storage import checkpointed
from skylattice.registry import Registry, table
from skylattice.sources import fits, matrix_store, mesh_store, text_tables
from skylattice.streaming import events as stream

R = Registry()


def _image_files(spark, d):
    """One file for each image of lines by supplier and part."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("img"), (F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 13).alias("c")).agg(F.sum("l_quantity").alias("v"))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        a = np.full((20, 13), np.nan)
        a[g.r.to_numpy(int), g.c.to_numpy(int)] = g.v.to_numpy()
        return pd.DataFrame({"path": [str(g.img.iloc[0])], "content": [fits.image_bytes(a, {"IMAGE": int(g.img.iloc[0]), "OBJECT": f"field {g.img.iloc[0]}"})]})

    return checkpointed(p.groupBy("img").applyInPandas(build, "path string, content binary"))


@R.query("fits_images", f"WITH {PX} SELECT img::BIGINT AS img, r::INT AS r, c::INT AS c, round(v, 2) AS v FROM px WHERE v IS NOT NULL")
def fits_images(spark, d):
    """Images written as files and read back as pixels; those without a value are null there."""
    p = fits.images_in(_image_files(spark, d)).where("v is not null")
    return p.select(F.col("file").cast("long").alias("img"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.round("v", 2).alias("v"))


@R.query("fits_headers", "SELECT l_linenumber::BIGINT AS img, 'field ' || l_linenumber AS object, 13::BIGINT AS nx, 20::BIGINT AS ny FROM lineitem GROUP BY l_linenumber")
def fits_headers(spark, d):
    h = fits.headers_in(_image_files(spark, d)).groupBy("file").pivot("key", ["OBJECT", "NAXIS1", "NAXIS2"]).agg(F.first("value"))
    return h.select(F.col("file").cast("long").alias("img"), F.col("OBJECT").alias("object"), F.col("NAXIS1").cast("long").alias("nx"), F.col("NAXIS2").cast("long").alias("ny"))


@R.query("ipac_round_trip", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier")
def ipac_round_trip(spark, d):
    """A table with a header of names and types, written and read as text."""
    path = work_dir(spark, "ipac")
    row = F.concat(F.lit(" "), F.lpad(F.col("s_suppkey").cast("string"), 12, " "), F.lit(" "), F.rpad("s_name", 30, " "), F.lit(" "), F.lpad(F.coalesce(F.col("s_acctbal").cast("string"), F.lit("null")), 16, " "), F.lit(" "))
    head = "\n".join("|" + "|".join(x.ljust(n) for x, n in zip(xs, (12, 30, 16), strict=True)) + "|" for xs in (("id", "name", "bal"), ("long", "char", "double")))
    spark.createDataFrame([("\\fixlen = T\n" + head,)], "value string").write.text(path)
    table(spark, d, "supplier").select(row.alias("value")).write.mode("append").text(path)
    return text_tables.read_ipac(spark, path)


@R.query("delimited_round_trip", "SELECT n_nationkey::DOUBLE AS key, n_name AS fits_name, n_regionkey::DOUBLE AS region FROM nation")
def delimited_round_trip(spark, d):
    """A table as a database client prints it: rule, names, rule, rows, and the number of rows."""
    path = work_dir(spark, "delimited")
    n = table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", F.format_string("%6d", "n_nationkey"), "n_name", F.col("n_regionkey").cast("string")))), "\n").alias("rows"), F.count("*").alias("n"))
    value = F.concat(F.lit("---+---+---\n key | fits_name | region\n---+---+---\n"), "rows", F.lit("\n("), F.col("n").cast("string"), F.lit(" rows)"))
    n.select(value.alias("value")).coalesce(1).write.text(path)
    return text_tables.read_delimited(spark, f"{path}/part-*", text=["fits_"])


@R.query("zone_counts", f"SELECT floor((dec + 90)/2.0)::INT AS zone, count(*) AS n FROM (SELECT {SKY.format(k='c_custkey')} FROM customer) GROUP BY 1")
def zone_counts(spark, d):
    """Rows of every zone of a stored catalog."""
    return mesh_store.cell_counts(spark, zone_store(spark, d))


@R.query("matrix_store", "SELECT l_suppkey AS source, floor(epoch_us(l_shipdate)/86400000000.0/30)::BIGINT AS e, max(l_extendedprice) AS mag, round(max(l_extendedprice)*2 - min(l_quantity), 4) AS late FROM lineitem GROUP BY 1, 2")
def matrix_store_query(spark, d):
    """Matched sources stored by field: one added, one deleted, two read."""
    path, m = work_dir(spark, "matrix"), checkpointed(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.floor(day("l_shipdate") / 30).alias("e")).agg(F.max("l_extendedprice").alias("a"), F.min("l_quantity").alias("b")))
    matrix_store.write(m.select("source", "e", F.col("a").alias("mag"), F.col("b").alias("err")), path)
    matrix_store.add(m.select("source", "e", (F.col("a") * 2 - F.col("b")).alias("late")), path, "late")
    matrix_store.delete(spark, path, "err")
    return rounded(matrix_store.read(spark, path, matrix_store.fields(spark, path)[::-1]).select("source", "e", "mag", "late"), "late", digits=4)


@R.query("stream_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ingest(spark, d, files_at_a_time=100):
    """Every batch of new files handed to a function, which sums it up and stores that once."""
    out = work_dir(spark, "ingest")

    def process(b, i):
        b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={i}")

    stream.ingest(_events(spark, d, files_at_a_time), process, work_dir(spark, "ingest-state"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@R.query("first_last_files", "SELECT o_orderstatus AS product, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def first_last_files(spark, d):
    """The earliest and the latest item of every product."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("product")).agg(F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"))


@R.query("sort_places", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS by_date, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey::VARCHAR, o_orderkey) AS by_text FROM orders")
def sort_places(spark, d):
    """Place of every item of a product in the order of dates, and in that of a number as text."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.col("o_custkey").cast("string").alias("name"))
    a = ranked(o, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "by_date", "n").drop("n")
    return ranked(a, ["o_orderstatus"], ["name", "o_orderkey"], "by_text", "n").select("o_orderkey", "by_date", "by_text")


@R.query("pad_lists", "WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, v[1] AS v1, v[2] AS v2, v[3] AS v3, v[4] AS v4, v[5] AS v5, v[6] AS v6, v[7] AS v7 FROM l")
def pad_lists(spark, d):
    """Lists of different length as the rows of a matrix; places that a list lacks are null."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("v"))
    return v.select("l_orderkey", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(7)])


_AT = 0.3
_WEIGHTS = [float(np.prod([(_AT - j) / (i - j) for j in range(-2, 3) if j != i])) for i in range(-2, 3)]


@R.query("interp_difference", MONTHS + f"SELECT source, e + {_AT} AS at, round(" + " + ".join(f"({w!r})*{f'lag(a, {-i}) OVER w' if i < 0 else f'lead(a, {i}) OVER w' if i else 'a'}" for i, w in zip(range(-2, 3), _WEIGHTS, strict=True)) + ", 4) AS v FROM m WINDOW w AS (PARTITION BY source ORDER BY e) QUALIFY lead(e, 2) OVER w - lag(e, 2) OVER w = 4")
def interp_difference(spark, d):
    """Fourth-order differences at a fixed place between evenly spaced epochs; none where neighbours are missing."""
    return transforms.difference_interpolation(_months(spark, d), "source", "e", "a", _AT).select("source", "at", F.round("v", 4).alias("v"))


_LAGS = (-2.5, -1.0, 0.0, 0.4, 3.0)


@R.query("lagged_chi2", f"WITH a AS (SELECT o_custkey % 20 AS g, epoch_us(o_orderdate)/86400000000.0 AS t, avg(o_totalprice/1000) AS m, 1.0 + count(*) AS e FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey % 20 AS g, epoch_us(o_orderdate)/86400000000.0 + 1 AS t, avg(o_totalprice/900) AS m, 2.0 + count(*) AS e FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1, 2), q AS (SELECT a.g, lag, a.t + lag AS t, a.m AS m1, a.e AS e1 FROM a, (SELECT unnest({list(_LAGS)!r})::DOUBLE AS lag)), x AS (SELECT q.*, p.t AS pt, p.m AS pm, p.e AS pe FROM q ASOF LEFT JOIN b p ON q.g = p.g AND q.t >= p.t), y AS (SELECT x.*, n.t AS nt, n.m AS nm, n.e AS ne FROM x ASOF LEFT JOIN b n ON x.g = n.g AND x.t <= n.t), z AS (SELECT g, lag, m1, e1, pm + coalesce((t-pt)/nullif(nt-pt, 0), 0)*(nm-pm) AS m2, pe + coalesce((t-pt)/nullif(nt-pt, 0), 0)*(ne-pe) AS e2 FROM y), s AS (SELECT g, lag, avg(m2-m1) AS md, avg(m2) AS a2, avg(m1) AS a1, stddev_samp(m1) AS s1, stddev_samp(m2) AS s2, count(m2) AS dof FROM z GROUP BY ALL) SELECT z.g, z.lag, round(coalesce(sum(pow(m2-m1-md, 2)/(e1*e1+e2*e2)), 0), 4) AS chi2, any_value(dof) AS dof, round(sum((m2-a2)*(m1-a1)/(s1*s2))/any_value(dof), 6) AS corr FROM z JOIN s USING (g, lag) GROUP BY ALL")
def lagged_chi2(spark, d):
    o = table(spark, d, "orders").withColumn("g", F.col("o_custkey") % 20).withColumn("t", day("o_orderdate"))
    a = o.groupBy("g", "t").agg(F.avg(F.col("o_totalprice") / 1000).alias("m"), (1.0 + F.count("*")).alias("e"))
    b = o.where("o_orderkey % 3 < 2").groupBy("g", (F.col("t") + 1).alias("t")).agg(F.avg(F.col("o_totalprice") / 900).alias("m"), (2.0 + F.count("*")).alias("e"))
    c = transforms.lagged_chi2(a, b, "g", _LAGS)
    return c.select("g", "lag", F.round("chi2", 4).alias("chi2"), "dof", F.round("corr", 6).alias("corr"))
