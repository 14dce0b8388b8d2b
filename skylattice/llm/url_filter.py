"""URL filters: a sort-merge range join of urls with prefix rules.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's; the longest rule wins.  A host is written with its
labels reversed, so that a rule becomes one interval of keys and the intervals
nest.  A url asks with one key for each number of labels that rules have.  Rule
starts, rule ends and asked keys are sorted together over range partitions; the
sweep adds one at a start and takes one off at an end, and what a key at depth
d has on top of its stack is the last start at depth d.  Depths and open rules
are carried from partition to partition, a row each.  Equal keys are dealt by a
salt, so a host with any share of the urls is met by many tasks.

All of it is DataFrame functions.  Keys are cut to the longest rule path: a
longer key falls into the same intervals.

Defined results: a null url or one without :// has an empty host and path; a
rule without a host fits every host; of rules of one host and path a block
wins; of rules of one length the one with the longer host; rules with a null
verdict or another one than allow and block are left out; a url that no rule
fits gets ``otherwise``.  Repeated rows and null ids each get their row; without
rules every url gets ``otherwise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of events, in their order at equal keys.
END, START, ASK = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    # the ends of host and path; a mark is added, so that one is always found
    host = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substr(rest, F.char_length(host) + 1), "[?#]", 2)[0]
    return F.translate(host, UPPER, LOWER), path


def labels_of(host: Column) -> Column:
    """Labels of a host from the right; none for an empty rule host."""
    return F.reverse(F.split(host, r"\.", -1))


def key_of(labels: Column, path: Column) -> Column:
    """Sortable key: labels, each closed by a dot, a slash (which no label holds), and the path."""
    return F.concat(F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), ""), F.lit("/"), path).cast("binary")


def clean_rules(rules: DataFrame) -> DataFrame:
    """Stored: one rule for each host and path, with its depth (labels) and key."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    r = rules.where(F.col("verdict").isin("allow", "block")).groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    labels = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(labels_of(F.col("host")))
    return store(r.withColumn("depth", F.size(labels)).withColumn("key", key_of(labels, F.col("path"))), "url-rules")


def swept(events: DataFrame) -> DataFrame:
    """(rid, rule) of the asked keys that lie in a rule's interval, with the innermost such rule.

    ``events``: key, kind, step (+1, -1, 0), rule, rid.
    """
    place = ["key", "kind", "salt"]
    d = events.withColumn("salt", F.coalesce(F.xxhash64("rid"), F.lit(0)))
    d = store(d.repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "url-events")
    # a row for each partition of the sort: how many rules are open where it begins
    ends = d.groupBy("part").agg(F.sum("step").alias("step"))
    ends = ends.select("part", F.coalesce(F.sum("step").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("open"))
    so_far = Window.partitionBy("part").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("here", F.sum("step").over(so_far)).join(F.broadcast(ends), "part").withColumn("level", F.col("here") + F.col("open"))
    # the stack: the last start at each level
    at_level = Window.partitionBy("part", "level").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("kind") == START, F.col("rule"))
    asked = d.withColumn("top", F.last(starts, ignorenulls=True).over(at_level)).where((F.col("kind") == ASK) & (F.col("level") > 0))
    # what earlier partitions left open: a row for each partition and level
    left = d.groupBy("part", "level").agg(F.max_by("rule", F.when(F.col("kind") == START, F.struct("key"))).alias("last"))
    before = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("part", "level", F.last("last", ignorenulls=True).over(before).alias("carried"))
    return asked.join(left, ["part", "level"]).select("rid", F.coalesce("top", "carried").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule, or null) and verdict of every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    base = store(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path")), "urls")
    known = clean_rules(rules)
    size = known.agg(F.collect_set("depth").alias("depths"), F.coalesce(F.max(F.char_length("path")), F.lit(0)).alias("longest")).first()
    rule = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    row = lambda key, kind, step, what, rid: [key.alias("key"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), what.alias("rule"), rid.cast("bigint").alias("rid")]
    first = known.select(*row(F.col("key"), START, 1, rule, F.lit(None)))
    # no text holds the byte FF, so this lies after all keys that begin with the rule's
    after = known.select(*row(F.concat("key", F.lit(b"\xff")), END, -1, F.lit(None), F.lit(None)))
    labels = labels_of(F.col("host"))
    keys = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(size["depths"])]).cast("array<int>"), lambda x: x <= F.size(labels)), lambda x: key_of(F.slice(labels, 1, x), F.substring("path", 1, size["longest"])))
    asks = base.select("rid", F.explode(keys).alias("key")).select(*row(F.col("key"), ASK, 0, F.lit(None), F.col("rid")))
    best = swept(first.unionByName(after).unionByName(asks)).groupBy("rid").agg(F.max("rule").alias("best"))
    return base.join(best, "rid", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: Rules of the registered query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT rid, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(verdict, length(r.host) + length(r.path)) AS verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
