"""Registered queries of names, headers, nested columns, stored tables, text files and set operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import text
from skylattice.operators import headers as hd
from skylattice.operators import names as nm
from skylattice.operators import tables as tb
from skylattice.plans.source_queries import work_dir
from skylattice.plans.storage import checkpointed
from skylattice.registry import Registry, table
from skylattice.sources import fits, table_store, text_tables

R = Registry()


# columns

@R.query("compare_names", "SELECT * FROM (VALUES (1, 'n_nationkey', 'n_nationkey', true), (2, 'n_name', 'name', false), (3, 'n_regionkey', 'n_regionkey', true), (4, NULL, 'n_comment', false)) t(pos, name, reference, same), LATERAL (SELECT CASE pos WHEN 1 THEN count(n_nationkey) WHEN 2 THEN count(n_name) WHEN 3 THEN count(n_regionkey) END AS n FROM nation)")
def compare_names(spark, d):
    """Columns against reference names, with the values that each holds."""
    n = table(spark, d, "nation")
    c = nm.compared(n, ["n_nationkey", "name", "n_regionkey", "n_comment"])
    return c.join(nm.filled(n).drop("pos"), "name", "left").select(F.col("pos").cast("int").alias("pos"), "name", "reference", "same", "n")


@R.query("column_positions", "SELECT * FROM (SELECT unnest([{'name': 'p_partkey', 'pos': 1, 'n': count(p_partkey)}, {'name': 'p_name', 'pos': 2, 'n': count(p_name)}, {'name': 'p_brand', 'pos': 3, 'n': count(p_brand)}, {'name': 'p_type', 'pos': 4, 'n': count(p_type)}, {'name': 'p_size', 'pos': 5, 'n': count(p_size)}, {'name': 'p_retailprice', 'pos': 6, 'n': count(p_retailprice)}], recursive := true) FROM part)")
def column_positions(spark, d):
    """Position of every column and the number of its values."""
    return nm.filled(table(spark, d, "part"))


@R.query("table_size", "SELECT count(*) AS n_rows, 6 AS n_columns, count(*) = 0 AS is_empty FROM part")
def table_size(spark, d):
    p = table(spark, d, "part")
    return p.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(p.columns)).alias("n_columns"), (F.col("n_rows") == 0).alias("is_empty"))


@R.query("edit_columns", "SELECT p_partkey AS id, p_size*2 AS twice, p_brand AS brand, p_size + 1 AS p_size FROM part")
def edit_columns(spark, d):
    """Insert at a position, rename, replace and delete columns."""
    p = tb.insert_column(table(spark, d, "part"), "twice", F.col("p_size") * 2, 2)
    p = p.withColumnsRenamed({"p_partkey": "id", "p_brand": "brand"}).withColumn("p_size", F.col("p_size") + 1)
    return p.drop("p_name", "p_type", "p_retailprice")


@R.query("apply_to_columns", "SELECT p_partkey, sqrt(p_size) AS p_size, sqrt(p_retailprice) AS p_retailprice FROM part")
def apply_to_columns(spark, d):
    """One function on chosen columns."""
    return table(spark, d, "part").select("p_partkey", *[F.sqrt(c).alias(c) for c in ("p_size", "p_retailprice")])


@R.query("column_struct", "SELECT p_size, count(*) AS n, min(p_retailprice) AS lo FROM part GROUP BY p_size")
def column_struct(spark, d):
    """Columns packed in a struct and taken out again."""
    p = table(spark, d, "part").select(F.struct("p_size", "p_retailprice").alias("s"))
    return p.groupBy("s.p_size").agg(F.count("*").alias("n"), F.min("s.p_retailprice").alias("lo"))


#: A long table of measurements with the names that different surveys use: a name for every line number.
_ALIASED = "a AS (SELECT l_orderkey, l_quantity, ['RAJ2000', 'pmDE', 'XWIN_IMAGE', 'parallax', 'unknown', 'dec', 'y'][l_linenumber] AS alias FROM lineitem), t(alias, key) AS (VALUES ('RAJ2000', 'RA'), ('pmDE', 'PMDec'), ('XWIN_IMAGE', 'X'), ('parallax', 'Plx'), ('dec', 'Dec'), ('y', 'Y'))"


def _aliased(spark, d) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("RAJ2000", "pmDE", "XWIN_IMAGE", "parallax", "unknown", "dec", "y")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.try_element_at(names, F.col("l_linenumber").cast("int")).alias("alias"))


@R.query("search_synonyms", f"WITH {_ALIASED} SELECT key, count(*) AS n, sum(l_quantity) AS total FROM a LEFT JOIN t USING (alias) GROUP BY key")
def search_synonyms(spark, d):
    """Measurements by the canonical key of the name that they carry; unknown names come together under null."""
    return nm.with_canonical(_aliased(spark, d), "alias", "key").groupBy("key").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@R.query("search_aliases", f"WITH {_ALIASED} SELECT t.key, t.alias, count(a.alias) AS n FROM (VALUES ('Plx', 'Plx'), ('Plx', 'plx'), ('Plx', 'parallax'), ('PMDec', 'PMDec'), ('PMDec', 'pmDE'), ('PMDec', 'pm_dec'), ('PMDec', 'pmdec')) t(key, alias) LEFT JOIN a ON a.alias = t.alias GROUP BY t.key, t.alias")
def search_aliases(spark, d):
    """All names of two keys, and how many measurements carry each."""
    used = _aliased(spark, d).groupBy("alias").agg(F.count("*").alias("n"))
    names = nm.synonym_table(spark).where(F.col("key").isin("Plx", "PMDec"))
    return names.join(used, "alias", "left").select("key", "alias", F.coalesce("n", F.lit(0)).alias("n"))


@R.query("positions_by_synonym", "SELECT (c_custkey*3 % 360)::DOUBLE AS RA, (c_custkey % 170 - 85)::DOUBLE AS \"Dec\", c_acctbal AS PMRA, NULL::DOUBLE AS PMDec, NULL::DOUBLE AS Plx FROM customer")
def positions_by_synonym(spark, d):
    """Position, motion and parallax by whatever names a table has for them."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select((k * 3 % 360).cast("double").alias("RAJ2000"), (k % 170 - 85).cast("double").alias("DEJ2000"), F.col("c_acctbal").alias("pmRA"))
    return nm.resolved(c, ["RA", "Dec", "PMRA", "PMDec", "Plx"])


@R.query("coordinate_types", "WITH c AS (SELECT l_orderkey, ['ra', 'x', 'Dec', 'y', 'mag', 'DEJ2000', 'ra_deg'][l_linenumber] AS name FROM lineitem WHERE l_quantity > 5) SELECT l_orderkey, CASE WHEN bool_or(name IN ('ra', 'ra_deg')) AND bool_or(name IN ('Dec', 'DEJ2000')) THEN 'sphere' WHEN bool_or(name = 'x') AND bool_or(name = 'y') THEN 'pix' END AS kind FROM c GROUP BY l_orderkey")
def coordinate_types(spark, d):
    """The kind of coordinates that the columns of many tables (orders) make."""
    names = F.array(*[F.lit(x) for x in ("ra", "x", "Dec", "y", "mag", "DEJ2000", "ra_deg")])
    c = table(spark, d, "lineitem").where("l_quantity > 5").select("l_orderkey", F.try_element_at(names, F.col("l_linenumber").cast("int")).alias("name"))
    return nm.coordinate_types(c, "l_orderkey", "name")


# headers: an order is a file, its columns are keys

HEAD = "h AS (SELECT o_orderkey AS file, k AS key, CASE k WHEN 'STATUS' THEN o_orderstatus WHEN 'PRIO' THEN o_orderpriority ELSE o_custkey::VARCHAR END AS value, 'c' AS comment FROM orders, (VALUES ('STATUS'), ('PRIO'), ('CUST')) v(k) WHERE NOT (k = 'PRIO' AND o_orderkey % 7 = 0))"


def _headers(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    rows = F.array(F.struct(F.lit("STATUS").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("PRIO").alias("key"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("CUST").alias("key"), F.col("o_custkey").cast("string").alias("value")))
    h = o.select(F.col("o_orderkey").alias("file"), F.explode(rows).alias("r")).select("file", "r.*", F.lit("c").alias("comment"))
    return h.where(~((F.col("key") == "PRIO") & (F.col("file") % 7 == 0)))


@R.query("header_is_value", f"WITH {HEAD} SELECT file, bool_or(key = 'PRIO' AND lower(trim(value)) = '1-urgent') AS is_val FROM h GROUP BY file")
def header_is_value(spark, d):
    return hd.has_value(_headers(spark, d), "PRIO", "1-URGENT")


@R.query("header_is_type", f"WITH {HEAD} SELECT file, bool_or(key IN ('PRIO', 'TYPE') AND lower(trim(value)) IN ('1-urgent', '2-high')) AS is_type FROM h GROUP BY file")
def header_is_type(spark, d):
    return hd.has_type(_headers(spark, d), ["PRIO", "TYPE"], ["1-URGENT", "2-HIGH"])


@R.query("header_replace", f"WITH {HEAD} SELECT file, key, CASE key WHEN 'STATUS' THEN 'X' WHEN 'PRIO' THEN 'none' ELSE value END AS value, comment FROM h UNION ALL SELECT o_orderkey, 'PRIO', 'none', '' FROM orders WHERE o_orderkey % 7 = 0")
def header_replace(spark, d):
    return hd.with_values(_headers(spark, d), {"STATUS": "X", "PRIO": "none"}, add=True)


@R.query("header_delete", f"WITH {HEAD} SELECT * FROM h WHERE key NOT IN ('STATUS', 'CUST')")
def header_delete(spark, d):
    return hd.without_keys(_headers(spark, d), ["STATUS", "CUST"])


@R.query("header_insert", f"WITH {HEAD} SELECT * FROM h UNION ALL SELECT DISTINCT file, k, v, 'new' FROM h, (VALUES ('OBSERVER', 'me'), ('TELESCOP', 'small')) n(k, v)")
def header_insert(spark, d):
    return hd.with_rows(_headers(spark, d), [("OBSERVER", "me", "new"), ("TELESCOP", "small", "new")])


@R.query("header_select", f"WITH {HEAD} SELECT * FROM h WHERE key IN ('STATUS', 'MISSING')")
def header_select(spark, d):
    return hd.only_keys(_headers(spark, d), ["STATUS", "MISSING"])


# nested columns and lists

@R.query("merge_structs", "SELECT s_suppkey, s_name, s_nationkey AS n, s_acctbal FROM supplier")
def merge_structs(spark, d):
    """Two structs as one; of a field that both have, the first one's."""
    s = table(spark, d, "supplier").select("s_suppkey", F.struct("s_name", F.col("s_nationkey").alias("n")).alias("a"), F.struct(F.lit(-1).alias("n"), "s_acctbal").alias("b"))
    return s.select("s_suppkey", nm.merged("a", "b", s.schema).alias("m")).select("s_suppkey", "m.*")


@R.query("nested_fields", "SELECT p_partkey, p_size AS found FROM part")
def nested_fields(spark, d):
    """A dotted path made of structs, and a field found by name at any depth."""
    p = table(spark, d, "part").select("p_partkey", nm.nested("head.image.size", F.col("p_size")))
    return p.select("p_partkey", F.col(nm.field_path(p.schema, "size")).alias("found"))


@R.query("fill_empty", "SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'NaN') AS kind FROM events")
def fill_empty(spark, d):
    kind = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(kind, F.lit("")), F.lit("NaN")).alias("kind"))


@R.query("join_lists", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '+' ORDER BY o_orderkey) AS joined, count(*) AS n FROM orders GROUP BY o_custkey")
def join_lists(spark, d):
    """Lists of a group as one list and as text: an order list of a customer is bounded by its orders."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return g.select("o_custkey", F.array_join(F.flatten(F.array("l")).cast("array<string>"), "+").alias("joined"), F.size("l").cast("long").alias("n"))


@R.query("format_strings", "SELECT p_partkey, printf('%s/%03d', p_brand, p_size) AS f, concat_ws('|', p_brand, p_type) AS joined, repeat(p_brand, 2) AS twice, upper(p_type) = p_type AS is_upper, 'x-' || p_brand AS prefixed FROM part")
def format_strings(spark, d):
    b, t = F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.format_string("%s/%03d", b, "p_size").alias("f"), F.concat_ws("|", b, t).alias("joined"), F.repeat(b, F.lit(2)).alias("twice"), (F.upper(t) == t).alias("is_upper"), F.concat(F.lit("x-"), b).alias("prefixed"))


@R.query("split_lines", "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, string_split(coalesce(text, ''), chr(10))[1] AS first_line FROM documents")
def split_lines(spark, d):
    x = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.size(x).cast("long").alias("n_lines"), F.get(x, F.lit(0)).alias("first_line"))


@R.query("name_styles", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x: upper(x[1:1]) || lower(x[2:])), '') AS camel, lower(replace(p_name, ' ', '_')) AS snake FROM part")
def name_styles(spark, d):
    """Names in one style and back."""
    camel = text.camel_column(F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, d, "part").select("p_partkey", camel.alias("camel"), text.snake_column(camel).alias("snake"))


# rows by place

@R.query("gather_places", "SELECT i.s_suppkey, p_retailprice AS v FROM supplier i LEFT JOIN part ON p_partkey = CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey*31 END")
def gather_places(spark, d):
    """Values at given places; a missing place or one outside gives null."""
    i = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") * 31).alias("k"))
    return i.join(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), "k", "left").select("s_suppkey", "v")


@R.query("insert_at", "SELECT n_nationkey + (SELECT count(*) FROM region WHERE r_regionkey*5 <= n_nationkey) AS pos, n_name AS name FROM nation UNION ALL SELECT r_regionkey*5 + r_regionkey, r_name FROM region")
def insert_at(spark, d):
    """Rows put before given places of a table; the places after them move on."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select((F.col("r_regionkey") * 5).cast("long").alias("pos"), F.col("r_name").alias("name"))
    return tb.insert_at(n, r, "pos")


@R.query("block_places", "SELECT p_partkey, p_partkey // 12 AS block, p_partkey % 12 // 4 AS r, p_partkey % 4 AS c FROM part")
def block_places(spark, d):
    """Places of a table cut into blocks of 3 by 4."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.floor(k / 12).alias("block"), F.floor(k % 12 / 4).alias("r"), (k % 4).alias("c"))


# relational operators by themselves

@R.query("semi_and_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def semi_and_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@R.query("set_operators", "SELECT 'both' AS kind, k FROM (SELECT s_suppkey AS k FROM supplier INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'left', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT o_custkey FROM orders)")
def set_operators(spark, d):
    s, o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return s.intersect(o).select(F.lit("both").alias("kind"), "k").unionByName(s.exceptAll(s.intersect(o)).select(F.lit("left").alias("kind"), "k"))


@R.query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@R.query("rankings", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
def rankings(spark, d):
    w = Window.partitionBy("c_nationkey")
    s = w.orderBy("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.rank().over(s).cast("long").alias("r"), F.dense_rank().over(s).cast("long").alias("dr"), F.ntile(4).over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("q"))


@R.query("theta_join", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 6")
def theta_join(spark, d):
    """A join on an inequality; the five regions are a fixed table, which bounds the side that is sent out."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n["n_nationkey"] > r["r_regionkey"] * 6).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@R.query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@R.query("map_values", "SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, count(DISTINCT o_orderstatus) AS n_keys FROM orders GROUP BY o_custkey")
def map_values(spark, d):
    """A map from status to total for each customer, read by key."""
    s = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    m = s.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    return m.select("o_custkey", F.try_element_at("m", F.lit("F")).alias("f"), F.size("m").cast("long").alias("n_keys"))


# stored tables

@contextmanager
def _stored(spark, d):
    """The suppliers as a stored table, which is dropped at the end of the block, whatever happens in it."""
    name = f"supplier_{uuid.uuid4().hex}"
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    try:
        table_store.create(s.withColumn("part", table_store.range_partition(F.col("s_acctbal"), 2000.0)), name, ["part"])
        yield name
    finally:
        for n in (name, f"{name}__new", f"{name}__old"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")


@R.query("store_select", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def store_select(spark, d):
    with _stored(spark, d) as n:
        return checkpointed(table_store.select(spark, n, ["s_suppkey", "s_name"], "s_acctbal > 0", [F.desc("s_acctbal"), "s_suppkey"], 20))


@R.query("store_insert", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def store_insert(spark, d):
    """Rows appended to a stored table; those whose key it has are left out, columns that it lacks are dropped."""
    with _stored(spark, d) as n:
        c = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), "c_mktsegment", F.lit(0.0).alias("part"))
        table_store.insert(c, n, unique_by=["s_suppkey"])
        return checkpointed(spark.table(n).select("s_suppkey", "s_name"))


@R.query("store_update", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def store_update(spark, d):
    with _stored(spark, d) as n:
        table_store.update(spark, n, F.col("s_nationkey") < 5, {"s_name": F.lit("moved")})
        return checkpointed(spark.table(n).select("s_suppkey", "s_name"))


@R.query("store_delete", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(s_acctbal < 1000, false)")
def store_delete(spark, d):
    with _stored(spark, d) as n:
        table_store.delete(spark, n, F.col("s_acctbal") < 1000)
        return checkpointed(spark.table(n).select("s_suppkey"))


@R.query("store_describe", "SELECT name, kind, CASE name WHEN 's_suppkey' THEN count(s_suppkey) WHEN 's_name' THEN count(s_name) WHEN 's_nationkey' THEN count(s_nationkey) WHEN 's_acctbal' THEN count(s_acctbal) ELSE count(floor(s_acctbal/2000)) END AS n FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double'), ('part', 'double')) t(name, kind), supplier GROUP BY name, kind")
def store_describe(spark, d):
    """Columns of a stored table, their types and the values that they hold."""
    with _stored(spark, d) as n:
        kinds = spark.createDataFrame(list(table_store.describe(spark, n).items()), "name string, kind string")
        return checkpointed(kinds.join(nm.filled(spark.table(n)).select("name", "n"), "name"))


@R.query("store_count", "SELECT count(*) AS n FROM supplier")
def store_count(spark, d):
    with _stored(spark, d) as n:
        return checkpointed(table_store.select(spark, n).agg(F.count("*").alias("n")))


# files

@R.query("fits_round_trip", "SELECT s_suppkey AS ID, s_acctbal AS BAL, s_name AS NAME FROM supplier")
def fits_round_trip(spark, d):
    """A binary table for each nation, built and read as bytes."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", "s_name")

    def build(g: pd.DataFrame) -> pd.DataFrame:
        content = fits.image_bytes(np.zeros((50, 50)))
        unit = fits.table_bytes({"ID": g.s_suppkey.to_numpy(), "BAL": g.s_acctbal.to_numpy(), "NAME": np.array(g.s_name.tolist(), "S")})
        return pd.DataFrame({"path": [str(g.s_nationkey.iloc[0])], "content": [content + unit[fits.BLOCK :]]})

    files = checkpointed(s.groupBy("s_nationkey").applyInPandas(build, "path string, content binary"))
    return fits.tables_in(files, files.orderBy("path").limit(1)).select("ID", "BAL", "NAME")


@R.query("csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark, d):
    p, path = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), work_dir(spark, "csv")
    p.write.option("header", True).option("sep", ";").csv(path)
    return spark.read.option("header", True).option("sep", ";").schema(p.schema).csv(path)


def _text(spark, df, label):
    path = work_dir(spark, label)
    df.select("value").write.text(path)
    return path


@R.query("fixed_width_round_trip", "SELECT s_suppkey AS id, trim(s_name) AS name, s_nationkey AS nation FROM supplier")
def fixed_width_round_trip(spark, d):
    s = table(spark, d, "supplier")
    path = _text(spark, s.select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad("s_name", 30, " "), F.lpad(F.col("s_nationkey").cast("string"), 4, " ")).alias("value")), "fixed")
    return text_tables.read_fixed_width(spark, path, [("id", 1, 12, "bigint"), ("name", 13, 30, "string"), ("nation", 43, 4, "int")])


@R.query("grep_lines", "SELECT p_name AS value FROM part WHERE contains(p_name, 'ring')")
def grep_lines(spark, d):
    return text_tables.grep(spark, _text(spark, table(spark, d, "part").select(F.col("p_name").alias("value")), "grep"), "ring").select("value")


@R.query("header_text_round_trip", "SELECT 'K' || s_suppkey AS key, s_name AS value, 'bal ' || s_nationkey AS comment FROM supplier")
def header_text_round_trip(spark, d):
    s = table(spark, d, "supplier")
    line = F.concat(F.lit("K"), F.col("s_suppkey").cast("string"), F.lit(" = '"), "s_name", F.lit("' / bal "), F.col("s_nationkey").cast("string"))
    return text_tables.read_header_text(spark, _text(spark, s.select(line.alias("value")), "header")).select("key", "value", "comment")


@R.query("ini_round_trip", "SELECT 'nation ' || n_nationkey AS section, k AS key, CASE k WHEN 'name' THEN n_name ELSE n_regionkey::VARCHAR END AS value FROM nation, (VALUES ('name'), ('region')) v(k)")
def ini_round_trip(spark, d):
    n = table(spark, d, "nation")
    block = F.concat(F.lit("[nation "), F.col("n_nationkey").cast("string"), F.lit("]\n; comment\nname = "), "n_name", F.lit("\nregion="), F.col("n_regionkey").cast("string"))
    return text_tables.read_ini(spark, _text(spark, n.select(block.alias("value")), "ini")).select("section", "key", "value")


@R.query("light_curve_text", "SELECT o_custkey AS object, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey")
def light_curve_text(spark, d):
    """Object headers with their epochs below, written and read as text."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"))).alias("l"))
    path = _text(spark, o.select(F.concat(F.lit("# "), F.col("o_custkey").cast("string"), F.lit(" r\n"), F.array_join("l", "\n")).alias("value")), "curves")
    back = text_tables.read_object_blocks(spark, path, [("object", "bigint"), ("filter", "string")], [("key", "bigint"), ("price", "double")])
    return back.groupBy("object").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@R.query("list_files", "SELECT 'nation.parquet' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region.parquet', count(*) FROM region")
def list_files(spark, d):
    """Files that match a pattern, with the rows of each."""
    files = [r.path for r in text_tables.file_list(spark, d, "^(nation|region)[.]parquet$").collect()]
    return text_tables.file_rows(spark.read.schema("dummy int").parquet(*files))


@R.query("stack_csv", "SELECT n_name AS name, n_nationkey AS k, 'nation' AS kind FROM nation UNION ALL SELECT r_name, r_regionkey, 'region' FROM region")
def stack_csv(spark, d):
    """Tables one below the other with a constant column each, as one folder of CSV files."""
    path = work_dir(spark, "stack")
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    table_store.append_stack([n, r], [{"kind": "nation"}, {"kind": "region"}], path)
    return spark.read.option("header", True).schema("name string, k int, kind string").csv(path)
