"""Line dedup: a suffix array over line sequences, built by distributed prefix doubling.

Lines that occur once cannot be in a repeated run, so only stretches of
repeated lines with MIN_WORDS words or more take part.  Level k ranks all
suffixes of these stretches by their first 2^k lines: the ranks of level k-1 at
a place and 2^(k-1) lines on are sorted over all machines.  Levels are added
until no rank splits any more, and the ranks are the order of the suffix array.

The array lies in range partitions.  Each suffix is compared with the one
before it (that of the partition before, for a first one), which gives the
longest common prefix; where that is shorter than the lines that make MIN_WORDS
words, an interval begins.  The suffixes of an interval share a run of at least
MIN_WORDS words; those that share further lines, up to where the next suffix
takes over, are its sub-intervals.  All but the first place of an interval are
later copies, and their lines are deleted: together these runs are the maximal
repeats.

Defined results: lines are compared without the white space around them; lines
without a word neither match nor interrupt a run; null and empty texts stay as
they are; the first copy is that of the smallest id (null first), then of the
first place; rows equal in id and text are one document and get the same
result; a document all of whose lines are later copies keeps an empty text.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches
from skylattice.llm.common import BROADCAST_BYTES, fresh, let, rows_and_attach, store

MIN_WORDS = 50


def line_rows(docs: DataFrame) -> DataFrame:
    """Stored: a row for every line with a word: doc_id, kid (text hash), p (place among them), li (line number), h, nw (words)."""

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "kid", "p", "li", "h", "nw")}
            for doc_id, kid, text in zip(c["doc_id"], c["kid"], c["text"], strict=True):
                p = 0
                for li, line in enumerate((text or "").split("\n")):
                    line = line.strip()
                    if line:
                        for k, v in zip(out, (doc_id, kid, p, li, xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63), len(line.split())), strict=True):
                            out[k].append(v)
                        p += 1
            return out

        return fn

    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("kid"), "text")
    return store(map_batches(d, make, "doc_id long, kid long, p int, li int, h long, nw int"), "lines")


def ranked(rows: DataFrame, key: str, salt: Column) -> tuple[DataFrame, int]:
    """Stored: rows with the place of their key among the sorted distinct keys (``rank``; key dropped), and how many keys there are.

    Range partitions are sorted one by one; the ids Spark then counts up
    follow that order over all of them.
    """
    keys = store(rows.groupBy(key).agg(F.count("*").alias("n")), "suffix-keys")
    ranks = store(keys.repartitionByRange(key).sortWithinPartitions(key).select(key, "n", F.monotonically_increasing_id().alias("rank")), "suffix-ranks")
    size = ranks.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return store(rows_and_attach(rows, ranks, key, "n", size["k"], size["n"], 64, salt).drop(key), "suffixes"), size["k"]


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Neighbouring repeated lines that have min_words words together: lines with an island number."""
    often = store(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated-lines")
    size = often.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    d = rows_and_attach(lines, often.withColumn("twice", F.lit(True)), "h", "n", size["k"], size["n"], 48, F.xxhash64("doc_id", "kid", "p"))
    d = d.where("twice").drop("twice").dropDuplicates(["doc_id", "kid", "p"])
    of_doc = Window.partitionBy("doc_id", "kid").orderBy("p")
    d = d.withColumn("island", F.col("p") - F.row_number().over(of_doc))
    d = d.withColumn("words", F.sum("nw").over(Window.partitionBy("doc_id", "kid", "island")))
    return d.where(F.col("words") >= min_words).drop("words")


def suffix_ranks(rows: DataFrame) -> DataFrame:
    """Stored: rows (doc_id, kid, island, p, h, ..) with ``line`` (the rank of the line) and ``rank`` (that of the suffix from it on); h dropped."""
    salt = F.xxhash64("doc_id", "kid", "p")
    rows, classes = ranked(rows, "h", salt)
    rows, ahead, before = rows.withColumn("line", F.col("rank")), 1, 0
    along = Window.partitionBy("doc_id", "kid", "island").orderBy("p")
    while classes > before:
        # behind the end of a stretch comes what is less than any line
        pair = F.struct(F.col("rank").alias("a"), F.coalesce(F.lead("rank", ahead).over(along), F.lit(-1).cast("bigint")).alias("b"))
        before = classes
        rows, classes = ranked(rows.withColumn("key", pair).drop("rank"), "key", F.struct(salt.alias("a"), F.xxhash64("p", "kid", "doc_id").alias("b")))
        ahead *= 2
    return rows


def prefix_sizes(nw: list[int], min_words: int) -> list[tuple[int, int]]:
    """For every start the least lines that hold min_words words, and the most that the next start does not cover.

    Starts too near to the end for min_words words are left out.
    """
    out, least, most, total, behind = [], 0, 0, 0, 0
    for start in range(len(nw)):
        while least < len(nw) and total < min_words:
            total += nw[least]
            least += 1
        if total < min_words:
            break
        if most <= start:
            most, behind = start + 1, 0
        while most < len(nw) and behind + nw[most] < min_words:
            behind += nw[most]
            most += 1
        out.append((least - start, max(least, most) - start))
        total -= nw[start]
        behind -= nw[start + 1] if most > start + 1 else 0
    return out


def suffixes(rows: DataFrame, min_words: int) -> DataFrame:
    """Every suffix of min_words words or more: doc_id, kid, p, rank, least, lines and ends (line numbers) of the lines that it may need."""
    whole = rows.groupBy("doc_id", "kid", "island").agg(F.array_sort(F.collect_list(F.struct("p", "li", "nw", "line", "rank"))).alias("s"))

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "kid", "p", "rank", "least", "lines", "ends")}
            for doc_id, kid, s in zip(c["doc_id"], c["kid"], c["s"], strict=True):
                for start, (least, most) in enumerate(prefix_sizes([x["nw"] for x in s], min_words)):
                    own = s[start : start + most]
                    for k, v in zip(out, (doc_id, kid, own[0]["p"], own[0]["rank"], least, [x["line"] for x in own], [x["li"] for x in own]), strict=True):
                        out[k].append(v)
            return out

        return fn

    return map_batches(whole.select("doc_id", "kid", "s"), make, "doc_id long, kid long, p int, rank long, least int, lines array<long>, ends array<int>")


def suffix_array(found: DataFrame) -> DataFrame:
    """Stored: suffixes with their place in the array (``pos``), the common prefix with the one before (``lcp``, in lines) and whether an interval begins."""
    order = ["rank", "doc_id", "kid", "p"]
    d = store(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "suffix-array")
    # a row for each partition of the sort
    ends = d.groupBy("part").agg(F.max_by("lines", F.struct(*order)).alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    w = Window.partitionBy("part").orderBy(*order)
    d = d.withColumn("pos", F.shiftleft(F.col("part").cast("bigint"), 33) + F.row_number().over(w)).withColumn("before", F.lag("lines").over(w))
    d = d.join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "end")).drop("end")
    differ = F.array_position(F.zip_with("lines", "before", lambda a, b: a.eqNullSafe(b)), False)
    d = d.withColumn("lcp", F.when(F.col("before").isNull(), 0).when(differ == 0, F.size("lines")).otherwise(differ - 1).cast("int"))
    return store(d.withColumn("begins", F.col("lcp") < F.col("least")).drop("before"), "common-prefixes")


def intervals(array: DataFrame) -> DataFrame:
    """Suffixes with the place where their interval begins (``interval``)."""
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = array.groupBy("part").agg(F.max(F.when(F.col("begins"), F.col("pos"))).alias("last"))
    last = last.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    own = F.max(F.when(F.col("begins"), F.col("pos"))).over(w)
    return array.withColumn("own", own).join(F.broadcast(last), "part").withColumn("interval", F.coalesce("own", "last")).drop("own", "last")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, kid and cuts [{from, to}] (line numbers, both deleted) of the documents that hold later copies."""
    found = suffixes(suffix_ranks(stretches(line_rows(docs), min_words)), min_words)
    d = intervals(suffix_array(found))
    # a suffix alone in its interval shares nothing
    several = store(d.groupBy("interval").agg(F.count("*").alias("n")).where("n > 1"), "shared-intervals")
    size = several.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    d = rows_and_attach(d, several.withColumn("shared", F.lit(True)), "interval", "n", size["k"], size["n"], 32, F.xxhash64("pos")).where("shared")
    d = d.withColumn("size", F.explode(F.sequence("least", F.size("lines"))))
    more = F.slice("lines", F.col("least") + 1, F.col("size") - F.col("least"))
    runs = d.select("doc_id", "kid", "p", F.col("ends")[0].alias("from"), F.col("ends")[F.col("size") - 1].alias("to"), F.struct("interval", "size", more.alias("more")).alias("name"))
    runs = store(runs, "runs")
    place = F.struct("doc_id", "kid", "p")
    first = store(runs.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "intervals")
    size = first.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    salt = F.struct(F.lit(-1).cast("bigint").alias("interval"), F.lit(0).alias("size"), F.array(F.xxhash64("doc_id", "kid", "p"), F.xxhash64("p", "kid")).alias("more"))
    # of the lines that name a sub-interval there are MIN_WORDS at most
    copies = rows_and_attach(runs, first, "name", "n", size["k"], size["n"], 96 + 8 * min_words, salt).where(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    return store(copies.groupBy("doc_id", "kid").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("cuts")), "cuts")


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, count: str | None = "__removed") -> DataFrame:
    """docs with the later copies cut out of text, other columns unchanged; one more column counts the deleted lines.

    That column is named ``count``, with underscores added where docs has one of that name; None leaves it out.
    """
    d, k, cut_list, removed = fresh(docs, "__d", "__k", "__cuts", count or "__removed")
    cuts = later_copies(docs, min_words).select(F.col("doc_id").alias(d), F.col("kid").alias(k), F.col("cuts").alias(cut_list))
    size = cuts.agg(F.coalesce(F.sum(F.size(cut_list) * 8 + 48), F.lit(0)).alias("b")).first()["b"]
    cuts = F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    j = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col(d)) & (key == F.col(k)), "left")
    lines = F.split(docs["text"], "\n", -1)
    spared = let(F.col(cut_list), lambda cut: F.filter(lines, lambda x, i: ~F.exists(cut, lambda c: (i >= c["from"]) & (i <= c["to"]))))
    text = F.when(F.col(cut_list).isNull(), docs["text"]).otherwise(F.array_join(spared, "\n"))
    gone = F.when(F.col(cut_list).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(spared)).cast("bigint")
    return j.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], *([gone.alias(removed)] if count else []))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, i, trim(raw[i]) AS line, len(string_split_regex(trim(raw[i]), '\s+')) AS nw FROM (SELECT doc_id, raw, unnest(range(1, len(raw)+1)) AS i FROM d) WHERE trim(raw[i]) <> ''),
q AS (SELECT *, row_number() OVER w AS p, sum(nw) OVER w AS c FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, list(line ORDER BY p) AS lines, list(i ORDER BY p) AS place, list(c ORDER BY p) AS cum FROM q GROUP BY doc_id),
r AS (SELECT a.doc_id, a.p AS p, min(b.p) AS e FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.nw >= 50 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.p), b.p FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.nw >= 50 GROUP BY 1, b.p),
n AS (SELECT r.doc_id, p, e, place[p] AS i0, place[e] AS i1, lines[p:e] AS run FROM r JOIN s USING (doc_id)),
f AS (SELECT *, min((doc_id, p)) OVER (PARTITION BY run) AS f FROM n),
x AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i0, i1+1)) AS j FROM f WHERE f <> (doc_id, p)) GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(raw, lambda y, j: NOT list_contains(gone, j)), chr(10)) END AS text, coalesce(len(gone), 0) AS n_removed FROM d LEFT JOIN x USING (doc_id)
"""
