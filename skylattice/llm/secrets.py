"""Secret scan with corpus-wide ownership frequency, as DataFrame expressions only.

Candidates are found in every whole text; their value hashes are counted over
distinct owners and distinct repositories (a repository belongs to one owner).
A value that many owners or many repositories hold is a copied example; one
that a single owner holds in few repositories and that looks random is
live-looking; what lies between is neither.

Defined results: null text counts as empty; repeated rows each get their row
and do not raise a frequency; rows with a null owner or repository share the
owner or repository null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import let, rows_and_attach, store

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Formats that issuers document: prefixed tokens, signed web tokens, private-key headers.
ISSUED = r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----)"
KINDS = ("assign", "access", "hex", "issued")
#: Matches that are added up one after the other; longer lists are added up by such parts first.
PART = 128


def ends(sizes: Column) -> Column:
    """Running sums of an array of lengths.

    Appending to an array copies it, so sums are built within parts of PART
    values and over the parts: a text of n matches costs n (PART + n / PART^2).
    """

    def within(part: Column, base: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out"))
        return F.aggregate(part, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PART).cast("int")), lambda i: F.slice(sizes, i * PART + 1, F.lit(PART)))
    many = let(parts, lambda p: let(within(F.transform(p, total), F.lit(0)), lambda sums: F.flatten(F.transform(p, lambda part, i: within(part, F.coalesce(F.get(sums, i - 1), F.lit(0)))))))
    return F.when(F.size(sizes) <= PART, within(sizes, F.lit(0))).otherwise(many)


def found(text: Column, kind: int, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Matches of a pattern: [{start, kind, end, value}] in code points, leftmost and non-overlapping.

    Splitting by the pattern gives the gaps and extracting gives the matches;
    their lengths add up to the places.  Texts without a match stop at rlike.
    """
    p = F.lit(pattern)

    def places(gaps: Column, sizes: Column, values: Column) -> Column:
        whole = F.transform(sizes, lambda n, i: n + F.get(gaps, i))
        spans = let(ends(whole), lambda at: F.transform(values, lambda v, i: F.struct((F.get(at, i) - F.get(sizes, i)).alias("start"), F.lit(kind).alias("kind"), F.get(at, i).alias("end"), v.alias("value"))))
        return F.filter(spans, lambda x: F.char_length(x["value"]) >= least)

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.char_length(x))
    spans = let(gaps, lambda g: let(sizes, lambda s: let(F.regexp_extract_all(text, p, F.lit(group)), lambda v: places(g, s, v))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind."""
    parts = [found(text, 0, ASSIGN, 2, 6), found(text, 1, ACCESS), found(text, 2, HEX), found(text, 3, ISSUED)]
    return F.array_sort(F.concat(*parts))


def looks_random(value: Column) -> Column:
    """At least 16 characters, digits and letters, and at least 8 different characters."""
    return (F.char_length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Stored table: one row per row of docs with a stable row id, its owner, repository and spans [{start, kind, end, value_hash, random}]."""
    d = docs.select("doc_id", owner.alias("owner"), repository.alias("repo"), candidates(F.coalesce("text", F.lit(""))).alias("c"))
    brief = F.transform("c", lambda x: F.struct(x["start"], x["kind"], x["end"], F.xxhash64(x["value"]).alias("value_hash"), looks_random(x["value"]).alias("random")))
    return store(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", brief.alias("spans")), "secrets")


def ownership(found_rows: DataFrame) -> DataFrame:
    """Frequency of each value: value_hash, n_owners, n_repos, n_rows.  Pre-aggregated by owner and repository, so a hot value is a few rows a task."""
    e = found_rows.where(F.size("spans") > 0).select("rid", "owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda x: x["value_hash"]))).alias("value_hash"))
    by = e.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by = by.groupBy("value_hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_rows"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, min_owners: int = 3, min_repos: int = 5, live_repos: int = 2) -> DataFrame:
    """One row per row of docs: counts, digests, spans, n_live / n_example by ownership, the most owners and repositories of a value.

    A candidate is an example if at least ``min_owners`` owners or
    ``min_repos`` repositories hold its value, and live-looking if one owner
    does, in at most ``live_repos`` repositories, and the value looks random.
    """
    a = scan(docs, owner, repository)
    freq = store(ownership(a), "secret-owners")
    size = freq.agg(F.count("*").alias("k"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()
    c = a.where(F.size("spans") > 0).select("rid", F.explode("spans").alias("s")).select("rid", "s.value_hash", "s.random")
    c = rows_and_attach(c, freq, "value_hash", "n_rows", size["k"], size["n"], 64, F.xxhash64("rid"))
    example = (F.col("n_owners") >= min_owners) | (F.col("n_repos") >= min_repos)
    live = (F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos) & F.col("random")
    c = c.groupBy("rid").agg(F.count_if(example).alias("n_example"), F.count_if(live).alias("n_live"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias("n_" + KINDS[k])
    base = joined(F.filter("spans", lambda x: x["kind"] < 3))
    out = a.join(c, "rid", "left")
    owned = [F.coalesce(k, F.lit(0)).alias(k) for k in ("n_example", "n_live", "max_owners", "max_repos")]
    return out.select("doc_id", kind(0), kind(1), kind(2), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *owned)


def _spans_sql(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, unnest(list_transform(range(1, len(m)+1), lambda k: {{'s': coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0), 'n': length(m[k]), 'v': v[k]}})) AS x, {least} AS least
FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS v FROM d) WHERE len(m) > 0"""


_NAME = str(list(KINDS)) + "[kind+1] || ':' || s || ':' || e"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT rid, kind, x.s AS s, x.s + x.n AS e, x.v AS v FROM ({" UNION ALL ".join(_spans_sql(*x) for x in ((0, ASSIGN, 2, 6), (1, ACCESS, 0, 1), (2, HEX, 0, 1), (3, ISSUED, 0, 1)))}) WHERE length(x.v) >= least),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) AS repos FROM c JOIN d USING (rid) GROUP BY v),
n AS (SELECT rid, string_agg({_NAME}, ',' ORDER BY s, kind) AS spans, string_agg({_NAME}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (owners >= 3 OR repos >= 5) AS n_example, max(owners) AS max_owners, max(repos) AS max_repos,
  count(*) FILTER (owners = 1 AND repos <= 2 AND length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8) AS n_live FROM c JOIN o USING (v) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos FROM d LEFT JOIN n USING (rid)
"""
