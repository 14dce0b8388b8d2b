"""Hard-negative mining by distributed radix selection.

Scores are integer inner products of quantised vectors.  Anchors are a stated
query set; they are taken a block at a time (a bounded size), and each block
meets all rows where they lie, without moving them.  For every window of scores
(an anchor's rows of the same label; then, for an anchor and a positive, the
scores between two shares of the positive's) tasks count the scores by digit.
The summed histogram tells the digit in which the k-th score lies, the next
pass counts only there, and so on.  Once few rows are left, or no digit, only
those that qualify are gathered and put in order.

A task sends the digits down to its own k-th score and, when rows are gathered,
its own first k: the k-th of all rows cannot lie below that of a task, so
nothing is lost, and ties of any number stay small.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; rows equal in all three count once;
different rows may share an id, and then are never positives of each other; a
vector shorter than another is filled up with zeros; components whose floor
exceeds 64 bits are cut there, and scores beyond 2^56 count as 2^56; an empty
table, or one without anchors, gives no rows.  Only the three columns named
are read, whatever others there are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import shared_dir, store

#: Anchors that are sent to the tasks at a time; with their windows and histograms a few tens of megabytes.
CHUNK = 4096
#: Bits of a digit, and the number of rows of a window that are gathered without further counting.
DIGIT, FEW = 8, 32
#: Anchors and rows that are multiplied together.
TILE_ANCHORS, TILE_ROWS = 512, 2048
#: Scores beyond this count as this, so that a hundred times a score is still a 64-bit number.
MOST = 1 << 56
#: Bytes of vectors in a file of the stored rows.
FILE_BYTES = 32 << 20
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Chunk:
    """Anchors with the score windows that are open: ``of[a, j]`` is the j-th window of anchor a (-1: none).

    A window holds the scores from ``high - span`` to ``high``; places in it
    count down from ``high``.  ``want`` rows of it are looked for, and
    ``prefix`` are the digits of the last one's place that are known.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    bound: int
    of: np.ndarray
    high: np.ndarray
    span: np.ndarray
    want: np.ndarray
    prefix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products of integer rows; ``bound`` is the most that one can be."""
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an array column as a matrix, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def meetings(c: Chunk, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place, vec_id) of the rows of a batch that lie in windows."""
    all_ids, all_labels = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
    vectors = padded(batch["q"], c.vectors.shape[1])
    live = np.flatnonzero((c.of >= 0).any(1))
    low = np.where(c.of >= 0, (c.high - c.span)[c.of], np.iinfo(np.int64).max).min(1) if len(live) else None
    for r in range(0, len(all_ids), TILE_ROWS):
        ids, labels = all_ids[r : r + TILE_ROWS], all_labels[r : r + TILE_ROWS]
        for at in range(0, len(live), TILE_ANCHORS):
            a = live[at : at + TILE_ANCHORS]
            s = products(c.vectors[a], vectors[r : r + TILE_ROWS], c.bound)
            in_class = labels == c.labels[a][:, None]
            near = (s >= low[a][:, None]) & ((in_class & (ids != c.ids[a][:, None])) if c.same else ~in_class)
            row, col = np.nonzero(near)
            score = s[row, col].astype(np.int64)
            for j in range(c.of.shape[1]):
                w = c.of[a[row], j]
                place = c.high[w] - score
                ok = (w >= 0) & (place >= 0) & (place <= c.span[w])
                yield w[ok], place[ok], ids[col[ok]]


def digit_counts(rows: DataFrame, shared, shift: int, width: int) -> DataFrame:
    """(w, digit, before, n): for each window the digit that holds the wanted row, the rows before it and those in it.

    Windows of fewer rows than wanted have no such digit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros(len(c.high) << width, np.int64)
        for batch in batches:
            for w, place, _ in meetings(c, batch):
                ok = place >> (shift + width) == c.prefix[w]
                np.add.at(total, (w[ok] << width) + (place[ok] >> shift & ((1 << width) - 1)), 1)
        n = total.reshape(-1, 1 << width)
        w, digit = np.nonzero((n > 0) & (n.cumsum(1) - n < c.want[:, None]))
        yield pa.RecordBatch.from_pydict({"w": w, "digit": digit, "n": n[w, digit], "want": c.want[w]}, schema=pa.schema([(k, pa.int64()) for k in ("w", "digit", "n", "want")]))

    h = rows.mapInArrow(count, "w long, digit long, n long, want long").groupBy("w", "digit", "want").agg(F.sum("n").alias("n"))
    h = h.withColumn("before", F.sum("n").over(Window.partitionBy("w").orderBy("digit")) - F.col("n"))
    return h.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want"))).select("w", "digit", "before", "n")


def first_of_each(w: np.ndarray, place: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each window by place, then id."""
    order = np.lexsort((ids, place, w))
    w, place, ids = w[order], place[order], ids[order]
    keep = np.arange(len(w)) - np.searchsorted(w, w) < k
    return w[keep], place[keep], ids[keep]


def gathered(rows: DataFrame, shared, k: int) -> DataFrame:
    """(w, place, vec_id, rank): the first k rows of each window."""
    names = ("w", "place", "vec_id")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        kept, waiting, n = (np.zeros(0, np.int64),) * 3, [], 0
        for batch in batches:
            for found in meetings(c, batch):
                waiting.append(found)
                n += len(found[0])
                if n > 1 << 18:
                    kept, waiting, n = first_of_each(*(np.concatenate(x) for x in zip(kept, *waiting, strict=True)), k), [], 0
        kept = first_of_each(*(np.concatenate(x) for x in zip(kept, *waiting, strict=True)), k)
        yield pa.RecordBatch.from_pydict(dict(zip(names, kept, strict=True)), schema=pa.schema([(x, pa.int64()) for x in names]))

    g = rows.mapInArrow(take, "w long, place long, vec_id long")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy("place", "vec_id"))).where(F.col("rank") <= k)


def select(rows: DataFrame, c: Chunk, k: int) -> DataFrame:
    """Stored: the first k rows of every window of a chunk (w, place, vec_id, rank)."""
    sc = rows.sparkSession.sparkContext
    whole, n = c.of, len(c.high)
    c.prefix, c.want = np.zeros(n, np.int64), np.full(n, k)
    last, before = c.span.copy(), np.zeros(n, np.int64)  # no row of a place after ``last`` qualifies; ``before`` rows surely do
    shift, unresolved = int(c.span.max(initial=0)).bit_length(), np.ones(n, bool)
    while shift and unresolved.any():
        width = min(DIGIT, shift)
        shift -= width
        c.of = np.where((whole >= 0) & unresolved[whole], whole, -1)
        shared = sc.broadcast(c)
        got = digit_counts(rows, shared, shift, width).toArrow()
        shared.destroy()
        w, digit, ahead, inside = (got[x].to_numpy() for x in ("w", "digit", "before", "n"))
        c.prefix[w] = (c.prefix[w] << width) + digit
        c.want[w] -= ahead
        before[w] += ahead
        last[w] = np.minimum(last[w], ((c.prefix[w] + 1) << shift) - 1)
        # a window without such a digit has fewer rows than wanted, and all of them are gathered
        unresolved[:] = False
        unresolved[w] = before[w] + inside > max(FEW, k)
    c.of, c.span = whole, last
    shared = sc.broadcast(c)
    out = store(gathered(rows, shared, k), "selected")
    shared.destroy()
    return out


def quantised(df: DataFrame, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """Stored: vec_id, label and q (floors of scaled components) of the rows that take part, in files of even size."""
    ok = F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    d = df.where(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), q.alias("q")).distinct()
    size = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    files = max(4 * df.sparkSession.sparkContext.defaultParallelism, size["n"] * (size["width"] or 1) * 8 // FILE_BYTES)
    return store(d.repartition(files), "vectors")


def anchor_chunks(rows: DataFrame, is_anchor: Column) -> tuple[DataFrame, int]:
    """Stored: the anchors with a chunk number; no chunk has over CHUNK of them (counted)."""
    anchors = rows.where(is_anchor)
    n = anchors.count()
    chunks = math.ceil(n / (0.8 * CHUNK)) if n > CHUNK else min(n, 1)
    while chunks:
        out = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(chunks)))
        if out.groupBy("chunk").count().agg(F.max("count")).first()[0] <= CHUNK:
            return store(out, "anchors"), chunks
        chunks += max(1, chunks // 8)
    return anchors, 0


def whole_windows(got: pa.Table, width: int, bound: int, most: int) -> Chunk:
    """For each anchor one window, over all scores, of the rows of its label."""
    n = got.num_rows
    return Chunk(got["vec_id"].to_numpy(), got["label"].to_numpy(), padded(got["q"].combine_chunks(), width), True, bound, np.arange(n)[:, None], np.full(n, most), np.full(n, 2 * most), np.zeros(n, np.int64))


def share_windows(c: Chunk, anchor: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> Chunk:
    """For each anchor (places in order) the windows between two scores, of the rows of other labels."""
    slot = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    of = np.full((len(c.ids), int(slot.max(initial=0)) + 1), -1)
    of[anchor, slot] = np.arange(len(anchor))
    return Chunk(c.ids, c.labels, c.vectors, False, c.bound, of, highest, highest - lowest, np.zeros(len(anchor), np.int64))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of stored rows (vec_id, label, q).

    For each anchor and each of its first ``positives`` rows of the same label:
    the first ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` hundredths of the positive's.  Columns: see OUT; stored.
    """
    spark = rows.sparkSession
    norm = F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    size = rows.agg(F.max(norm).alias("norm"), F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    width, bound = size["width"] or 0, int((size["most"] or 0.0) ** 2) * (size["width"] or 0) + 1
    most = min(int((size["norm"] or 0.0) * (1 + 1e-9)) + 1, MOST)
    path = f"{shared_dir(spark)}/skylattice-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(f"{path}/chunk=-1")
    anchors, chunks = anchor_chunks(rows, is_anchor)
    for chunk in range(chunks):
        base = whole_windows(anchors.where(F.col("chunk") == chunk).select("vec_id", "label", "q").toArrow(), width, bound, most)
        found = select(rows, base, positives).orderBy("w", "rank").toArrow()
        anchor, positive = found["w"].to_numpy(), found["vec_id"].to_numpy()
        score = most - found["place"].to_numpy()
        lowest, highest = -((-score * low) // 100), score * high // 100
        some = np.flatnonzero(lowest <= highest)  # not so for negative scores: their shares run the other way
        windows = share_windows(base, anchor[some], lowest[some], highest[some])
        named = pa.table({"w": np.arange(len(some)), "anchor_id": base.ids[anchor[some]], "positive_id": positive[some], "positive_score": score[some], "top": highest[some]})
        if not len(some):
            continue
        out = select(rows, windows, negatives).join(F.broadcast(spark.createDataFrame(named)), "w")
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", (F.col("top") - F.col("place")).alias("negative_score")).write.parquet(f"{path}/chunk={chunk}")
    return spark.read.schema(OUT + ", chunk int").parquet(path).drop("chunk")


ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY a, p.b ORDER BY n.score DESC, n.b))::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (a) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""
