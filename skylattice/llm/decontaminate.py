"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Training texts are scanned window by window with DataFrame operations only;
hash hits are verified word by word, and hit words are counted, cut out as
spans, or the documents dropped.

Defined results: null or empty text has no words and is never contaminated;
repeated rows each get their row; repeated items and items with equal text
count each by its id; items with a null id mark words but are not counted;
an empty benchmark leaves every document clean.  A word is a run of ASCII
letters, digits and non-ASCII characters, ASCII letters in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import BROADCAST_BYTES, fresh, let, store

WINDOW = 13
#: Copies of a benchmark window where the benchmark is not broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of a text; for pure ASCII, lower() is the same as translating A-Z and quicker."""
    t = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(small, BREAK, -1), "")


def gram_hash(word_hashes: Column, at: Column | int, k: Column | int) -> Column:
    """Hash of k words from their own hashes: every word is hashed once, not once for each window that holds it."""
    return F.xxhash64(F.slice(word_hashes, at, k), F.lit(k) if isinstance(k, int) else k)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: gram_hash, gram_len, gram (words), items (distinct ids holding it)."""
    w = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.lit(window), F.size("w")))
    g = w.select("item_id", "len", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("gram"))
    return g.groupBy(gram_hash(hashed(F.col("gram")), 1, F.col("len")).alias("gram_hash"), F.col("len").alias("gram_len"), "gram").agg(F.collect_set("item_id").alias("items"))


def n_windows(n: Column, k: int) -> Column:
    return F.greatest(n - (k - 1), F.lit(0))


def place(lens: list[int], n: Column) -> Column:
    """Word position of hash number ``at``: after the marker, the windows of each length follow one another."""
    start, before = F.lit(None).cast("int"), F.lit(1)
    for k in lens:
        start = F.when(F.col("gram_len") == k, F.col("at") - before).otherwise(start)
        before = before + n_windows(n, k)
    return start


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): n_rows of it, n_words, spans [{pos, len}] of verified windows, items.

    One scan: each document sends its window hashes and a marker (position
    -1) through the join, so nothing has to be joined back.
    """
    grams = benchmark_grams(benchmark, window)
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("gram", " ")) + 8 * F.size("items") + 64), F.lit(0)).alias("b"), F.collect_set("gram_len").alias("lens")).first()
    lens = sorted(size["lens"], reverse=True) or [window]
    n = F.size("w")

    def hashes(g: Column, k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n_windows(n, k)), lambda i: gram_hash(g, i, k))).otherwise(F.array().cast("array<bigint>"))

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.xxhash64("t").alias("kid"), normal_words(F.col("t")).alias("w"))
    d = d.select("doc_id", "kid", "w", let(hashed(F.col("w")), lambda g: F.concat(F.array(F.lit(0).cast("bigint")), *[hashes(g, k) for k in lens])).alias("hashes"))
    if size["b"] > BROADCAST_BYTES:
        return spread_hits(d, grams, lens)
    # the outer form: from the plain one Catalyst infers a filter that computes the words again
    d = d.select("doc_id", "kid", "w", F.posexplode_outer("hashes").alias("at", "gram_hash"))
    j = d.join(F.broadcast(grams), "gram_hash", "left")
    mark = F.col("at") == 0
    j = j.withColumn("pos", F.when(mark, F.lit(-1)).otherwise(place(lens, n)))
    true = (F.col("pos") >= 0) & (F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.coalesce("gram_len", F.lit(1))) == F.col("gram"))
    j = j.where(mark | true)
    j = j.select("doc_id", "kid", mark.alias("mark"), F.when(mark, n).alias("n"), F.when(~mark, F.struct("pos", F.col("gram_len").alias("len"))).alias("span"), F.when(~mark, F.col("items")).alias("items"))
    return j.groupBy("doc_id", "kid").agg(F.count_if("mark").alias("n_rows"), F.max("n").cast("bigint").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def spread_hits(d: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """window_hits for a benchmark too large to broadcast.

    Only hashes go through the equi-join, without the words; each window of
    the benchmark is copied to SALTS places, so that one that many documents
    hold is met by several tasks.  Hits are verified where the words are.
    """
    salt = F.pmod(F.xxhash64("doc_id", "kid"), F.lit(SALTS)).cast("int")
    h = d.select("doc_id", "kid", salt.alias("salt"), F.size("w").alias("n"), F.posexplode_outer("hashes").alias("at", "gram_hash")).where("at > 0")
    g = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = h.join(g, ["gram_hash", "salt"]).select("doc_id", "kid", F.struct(place(lens, F.col("n")).alias("pos"), F.col("gram_len").alias("len"), "gram", "items").alias("x"))
    met = met.groupBy("doc_id", "kid").agg(F.collect_set("x").alias("met")).select(F.col("doc_id").alias("__d"), F.col("kid").alias("__k"), "met")
    one = d.groupBy("doc_id", "kid").agg(F.count("*").alias("n_rows"), F.first("w").alias("w"))
    j = one.join(met, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("kid") == F.col("__k")), "left")
    hits = F.coalesce("met", F.array().cast(met.schema["met"].dataType))
    # a slice of an array as it comes from a shuffle reads all of it; of one made here, only the slice
    true = let(F.transform("w", lambda x: x), lambda w: F.filter(hits, lambda x: F.slice(w, x["pos"] + 1, x["len"]) == x["gram"]))
    j = j.select("doc_id", "kid", "n_rows", F.size("w").cast("bigint").alias("n_words"), true.alias("true"))
    spans = F.array_sort(F.array_distinct(F.transform("true", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len")))))
    return j.select("doc_id", "kid", "n_rows", "n_words", spans.alias("spans"), F.array_distinct(F.flatten(F.transform("true", lambda x: x["items"]))).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside at least one span; spans sorted by position."""
    step = lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).cast("bigint").alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")), step, lambda a: a["n"])


def score_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kid, n_words, n_hit, n_items, items_sha256, contaminated, spans; one row per row of docs."""
    h = window_hits(docs, benchmark, window).withColumn("n_hit", covered(F.col("spans")))
    h = h.withColumn("ids", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    h = h.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    h = h.select("doc_id", "kid", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), "contaminated", "spans", "n_rows")
    return h.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).drop("again", "n_rows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated documents, columns unchanged.  Their ids are broadcast if they are few, so that no clean text is moved."""
    d, k = fresh(docs, "__d", "__k")
    bad = store(score_contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias(d), F.col("kid").alias(k)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() * 48 <= BROADCAST_BYTES else bad
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (key == F.col(k)), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the words of each text outside every verified window (one row per row of docs)."""
    hits = score_contamination(docs, benchmark, window).select(F.col("doc_id").alias("__d"), F.col("kid").alias("__k"), "spans").distinct()
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("kid"), normal_words(F.col("text")).alias("w"))
    j = d.join(hits, d["doc_id"].eqNullSafe(F.col("__d")) & (F.col("kid") == F.col("__k")), "left")
    keep = let(F.col("spans"), lambda s: F.filter(F.col("w"), lambda x, i: ~F.exists(s, lambda y: (i >= y["pos"]) & (i < y["pos"] + y["len"]))))
    return j.select("doc_id", F.array_join(keep, " ").alias("text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, list_slice(w, i, i+k-1) AS gram FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w)-least(13, len(w))+2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT rid, k, i, list_slice(w, i, i+k-1) AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w)-k+2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
hit AS (SELECT rid, item_id, i, win.k FROM win JOIN g ON win.k = g.k AND win.gram = g.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i+k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
