"""Near-duplicates by consistent weighted sampling.

Five-word shingles are weighted by their count in the text times their inverse
document frequency.  Improved consistent weighted sampling draws SAMPLES
shingles a text; bands of ROWS samples make buckets; candidates are verified by
their exact weighted Jaccard similarity, and verified links make classes.

No bucket is expanded into all its pairs: its members are first compared with
the member that shares most buckets; members that are still in different
classes afterwards meet in blocks of bounded size, where only links that join
classes leave the task.

Defined results: words are lower-case runs of letters, digits and non-ASCII
characters; a text of fewer than five words is one shingle; all texts without
words (null, empty) are one class; repeated rows are in one class; a class is
named by its smallest id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import SLICE, map_batches
from skylattice.llm.common import BROADCAST_BYTES, HOT_PARTS, attach_wide, fresh, rows_and_attach, store
from skylattice.llm.textkit import WORD, groups, mix, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: 16 bands of 3 samples: at similarity 0.8 all bands fail once in 10^5.
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Candidates below this share of equal samples are dropped; at similarity 0.8 that is over 5 deviations away.
LEAST_EQUAL = 0.5
#: Document frequencies are counted by bucket of the shingle's hash.
FREQ_BITS = 18
#: Members of a bucket, and bytes of their shingles, that one task compares with each other at a time.
BLOCK, BLOCK_BYTES = 256, 8 << 20

_RNG = np.random.default_rng(77)
SEEDS = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
STEPS = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law at the middle of n equal parts, by bisection."""
    want, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < want
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo


GAMMA = gamma_quantiles(4096)
R, INV_R, LN_C = (x.astype(np.float32) for x in (GAMMA, 1 / GAMMA, np.log(GAMMA)))


def draw(e: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of shingles ``e`` (sorted hashes) with log weights: 32 bits each."""
    least = np.full(SAMPLES, np.inf, np.float32)
    value = np.zeros(SAMPLES, np.uint64)
    rows = np.arange(SAMPLES)
    for at in range(0, len(e), 8192):
        part, w = e[at : at + 8192], ln_w[at : at + 8192]
        x = (part[None, :] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        i = (x >> np.uint64(52)).view(np.int64)
        beta = (x & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
        t = np.floor(w * INV_R[i] + beta)
        a = LN_C[((x >> np.uint64(40)) & np.uint64(4095)).view(np.int64)] - R[i] * (t - beta + 1)
        j = a.argmin(1)
        low = a[rows, j]
        better = low < least
        least[better] = low[better]
        value[better] = mix(part[j] + t[rows, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[better]
    return (value >> np.uint64(32)).astype(np.uint32)


def bucket_of(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(64 - FREQ_BITS)).astype(np.int64)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text's word hashes, in order."""
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += h[i : i + n] * STEPS[i]
    return mix(s)


def shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text's word hashes, sorted, and their weights."""
    e, count = np.unique(shingle_hashes(h), return_counts=True)
    return e, (count * idf[bucket_of(e)]).astype(np.float32)


def words_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, _, buf, at in groups([(t or "").lower() for t in texts]):
        h, starts, _, _ = word_hashes(buf, WORD)
        cut = np.searchsorted(starts, at)
        for k in range(len(at) - 1):
            yield h[cut[k] : cut[k + 1]]


def text_key(h: np.ndarray) -> tuple[int, int]:
    """128-bit name of a word sequence."""
    place = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
    a = mix(h ^ place).sum(dtype=np.uint64) + np.uint64(len(h))
    b = mix(h * np.uint64(0x9E3779B97F4A7C15) + place).sum(dtype=np.uint64)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def shingle_idf(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency by bucket of shingles, counted over all texts; a task sends one row a bucket at most.

    As in hashed term frequencies, shingles of one bucket share a count: its
    table stays a few megabytes at any corpus size, and the frequency of a
    bucket without a common shingle is about the same for all of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << FREQ_BITS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for h in words_of(batch.slice(at, SLICE).column(0).to_pylist()):
                    total[np.unique(bucket_of(shingle_hashes(h)))] += 1
                    n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(used, -1), "n": np.append(total[used], n)}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    got = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, count_of = got["bucket"].to_numpy(), got["n"].to_numpy()
    freq = np.zeros(1 << FREQ_BITS)
    freq[bucket[bucket >= 0]] = count_of[bucket >= 0]
    n = count_of[bucket < 0].sum()
    return (1 + np.log((n + 1) / (freq + 1))).astype(np.float32)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """Stored: rid (stable row id), doc_id, text_hash, key_a, key_b (exact word sequence), weight, sample (SAMPLES x 4 bytes)."""

    def make():
        table = idf.value

        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"rid": c["rid"], "doc_id": c["doc_id"], "text_hash": c["text_hash"], "key_a": [], "key_b": [], "weight": [], "sample": []}
            for h in words_of(c["text"]):
                e, w = shingles(h, table)
                a, b = text_key(h)
                out["key_a"].append(a)
                out["key_b"].append(b)
                out["weight"].append(float(w.sum(dtype=np.float64)))
                out["sample"].append(draw(e, np.log(w)).tobytes() if len(e) else None)
            return out

        return fn

    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return store(map_batches(d, make, "rid long, doc_id long, text_hash long, key_a long, key_b long, weight double, sample binary"), "signatures")


def equal_share(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).mean())


def could_match(share: float, wa: float, wb: float) -> bool:
    """Neither the samples nor the total weights rule out a similarity of SIMILAR."""
    return share >= LEAST_EQUAL and min(wa, wb) >= SIMILAR * max(wa, wb) * 0.9999


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node) for every band of every node with a sample."""
    bands = F.array(*[F.xxhash64(F.substring("sample", 4 * ROWS * b + 1, 4 * ROWS), F.lit(b)) for b in range(BANDS)])
    return nodes.where("sample is not null").select("node", F.posexplode(bands).alias("band", "bucket"))


def hub_candidates(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs leader-member that could match, stored; rows of buckets with several members, stored with leader and size).

    The leader of a bucket is the member that meets most others over all its
    buckets: of copies of one text that differ from each other, that text.
    """
    several = store(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    size = several.agg(F.count("*").alias("k"), F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()
    salt = F.xxhash64("node", F.lit(5))
    r = rows_and_attach(rows, several.withColumn("met", F.col("size")), "bucket", "size", size["k"], size["n"], 48, salt)
    r = store(r.where("met is not null"), "bucket-rows")
    meets = store(r.groupBy("node").agg(F.sum("met").alias("meets")), "meets")
    r = r.join(meets, "node")
    hubs = store(r.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("meets"), F.col("node"))).alias("leader"), F.count("*").alias("size")), "hubs")
    r = rows_and_attach(r.drop("met", "meets"), hubs, "bucket", "size", size["k"], size["n"], 48, salt)
    r = store(r, "bucket-leaders")
    pairs = store(r.where("leader <> node").select("leader", F.col("node").alias("member")).distinct(), "hub-pairs")
    return could_match_pairs(pairs, nodes), r


def hot_keys(pairs: DataFrame, key: str) -> DataFrame:
    """Keys with over 1/HOT_PARTS of the pairs: stored, a bounded number of ids."""
    n = pairs.count()
    return store(pairs.groupBy(key).count().where(F.col("count") > max(64, n // HOT_PARTS)).select(key), "hot")


def could_match_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    sketch = lambda c, p: nodes.select(F.col("node").alias(c), F.col("sample").alias(p + "s"), F.col("weight").alias(p + "w"))
    j = attach_wide(pairs, sketch("leader", "l"), "leader", hot_keys(pairs, "leader"), F.col("member")).join(sketch("member", "m"), "member")

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            good = [i for i in range(len(c["ls"])) if could_match(equal_share(c["ls"][i], c["ms"][i]), c["lw"][i], c["mw"][i])]
            return {k: [c[k][i] for i in good] for k in ("leader", "member")}

        return fn

    return store(map_batches(j.select("leader", "member", "ls", "ms", "lw", "mw"), make, "leader long, member long"), "candidates")


def texts_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored: node and text of the wanted nodes; no other text is moved."""
    needed = store(wanted.select("node").distinct().join(nodes.select("node", "first_id", "key_a", "key_b"), "node"), "needed")
    ids = needed.select(F.col("first_id").alias("__id")).distinct()
    ids = F.broadcast(ids) if needed.count() * 16 <= BROADCAST_BYTES else ids
    d = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            keys = [text_key(h) for h in words_of(c["text"])]
            return {"key_a": [k[0] for k in keys], "key_b": [k[1] for k in keys], "text": c["text"]}

        return fn

    texts = map_batches(d, make, "key_a long, key_b long, text string").join(needed, ["key_a", "key_b"])
    return store(texts.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """Stored: the pairs whose exact weighted Jaccard similarity is at least SIMILAR."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("leader", "member")).alias("node")), nodes)
    side = lambda c, p: texts.select(F.col("node").alias(c), F.col("text").alias(p))
    j = attach_wide(pairs, side("leader", "lt"), "leader", hot_keys(pairs, "leader"), F.col("member")).join(side("member", "mt"), "member")

    def make():
        table = idf.value
        last: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"leader": [], "member": []}
            members = words_of(c["mt"])
            for leader, member, text, h in zip(c["leader"], c["member"], c["lt"], members, strict=True):
                if leader not in last:
                    last.clear()  # rows come sorted by leader
                    last[leader] = shingles(next(words_of([text])), table)
                if weighted_jaccard(*last[leader], *shingles(h, table)) >= SIMILAR:
                    out["leader"].append(leader)
                    out["member"].append(member)
            return out

        return fn

    return store(map_batches(j.select("leader", "member", "lt", "mt").sortWithinPartitions("leader"), make, "leader long, member long"), "links")


def weighted_jaccard(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights of two sorted shingle lists."""
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64)
    both = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low
    return float(low / both) if both > 0 else 1.0


def components(links: DataFrame) -> DataFrame:
    """Stored: node, label (smallest node of its component) for the nodes of links.

    Every round a node takes the least label around it and then its label's
    label; hot hubs are met by joins that cannot skew.
    """
    both = store(links.select(F.explode(F.array(F.struct(F.col("leader").alias("u"), F.col("member").alias("v")), F.struct(F.col("member").alias("u"), F.col("leader").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"), F.count("*").alias("deg")).select(F.col("u").alias("node"), "label", "deg"), "labels")
    while True:
        size = labels.agg(F.count("*").alias("k"), F.coalesce(F.sum("deg"), F.lit(0)).alias("n")).first()
        near = rows_and_attach(both, labels.select(F.col("node").alias("v"), "label", "deg"), "v", "deg", size["k"], size["n"], 48, F.xxhash64("u", F.lit(9)))
        near = near.groupBy("u").agg(F.min("label").alias("near"))
        stepped = store(labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"), "deg"), "labels")
        holders = stepped.groupBy("label").agg(F.count("*").alias("held")).join(stepped.select(F.col("node").alias("label"), F.col("label").alias("top")), "label")
        k = stepped.select("label").distinct().count()
        new = rows_and_attach(stepped, holders.select("label", "held", "top"), "label", "held", k, size["k"], 48, F.xxhash64("node", F.lit(11)))
        labels = store(new.select("node", F.coalesce("top", "label").alias("label"), "deg", "old"), "labels")
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.drop("old")


def open_pairs(sample: np.ndarray, weight: np.ndarray, label: np.ndarray, own: np.ndarray, band: int, inside: bool, a: int) -> np.ndarray:
    """Members after ``a`` of a block (pair) that could match it, are in another class, and do not meet it in an earlier band."""
    same = sample[a] == sample[a + 1 :]
    ok = (same.mean(1) >= LEAST_EQUAL) & (np.minimum(weight[a], weight[a + 1 :]) >= SIMILAR * np.maximum(weight[a], weight[a + 1 :]) * 0.9999) & (label[a + 1 :] != label[a])
    if not inside:
        ok &= own[a + 1 :] != own[a]
    if band and ok.any():
        ok &= ~same[:, : band * ROWS].reshape(len(same), band, ROWS).all(2).any(1)
    return np.flatnonzero(ok) + a + 1


def block_members(m: list[dict]) -> tuple[np.ndarray, ...]:
    m.sort(key=lambda x: x["node"])
    return np.array([np.frombuffer(x["sample"], np.uint32) for x in m]), *(np.array([x[k] for x in m]) for k in ("weight", "label", "own", "node"))


def leftover_blocks(rows: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored: rows (bucket, band, i, j, own, node, label) of blocks, only of members that could match one of another class there.

    A bucket whose members are all in one class is done.  Members of others
    are dealt to blocks; every pair of blocks is a group of its own.
    """
    salt = F.xxhash64("node", F.lit(5))
    r = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(nodes.select("node", "weight"), "node")
    r = store(r.select("bucket", "band", "node", "label", "weight"), "bucket-members")
    live = r.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).where("n > 2 and a < b")
    # every shingle weighs 1 at least, so 12 bytes a unit of weight bound the shingles
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") * 12 / BLOCK_BYTES)).cast("int")
    live = store(live.select("bucket", "n", blocks.alias("blocks")), "live-buckets")
    size = live.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    r = rows_and_attach(r, live, "bucket", "n", size["k"], size["n"], 48, salt).where("blocks is not null")
    own = F.pmod(F.xxhash64("node", F.lit(13)), F.col("blocks")).cast("int")
    r = r.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = r.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "weight").join(nodes.select("node", "sample"), "node")
    grouped = r.groupBy("bucket", "band", "i", "j").agg(F.collect_list(F.struct("own", "node", "label", "sample", "weight")).alias("m"))

    def make():
        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("bucket", "band", "i", "j", "own", "node", "label")}
            for bucket, band, i, j, m in zip(c["bucket"], c["band"], c["i"], c["j"], c["m"], strict=True):
                sample, weight, label, own, node = block_members(m)
                hit = np.zeros(len(m), bool)
                for a in range(len(m)):
                    near = open_pairs(sample, weight, label, own, band, i == j, a)
                    hit[near] = True
                    hit[a] |= len(near) > 0
                for k in np.flatnonzero(hit):
                    for name, v in zip(out, (bucket, band, i, j, int(own[k]), int(node[k]), int(label[k])), strict=True):
                        out[name].append(v)
            return out

        return fn

    return store(map_batches(grouped, make, "bucket long, band int, i int, j int, own int, node long, label long"), "leftovers")


def leftover_links(docs: DataFrame, blocks: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """Stored: verified links between classes that meet in a block; each block gives a spanning forest of them, not all pairs."""
    texts = texts_of(docs, blocks, nodes)
    r = blocks.join(nodes.select("node", "sample", "weight"), "node").join(texts, "node")
    grouped = r.groupBy("bucket", "band", "i", "j").agg(F.collect_list(F.struct("own", "node", "label", "sample", "weight", "text")).alias("m"))

    def make():
        table = idf.value

        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"leader": [], "member": []}
            for band, i, j, m in zip(c["band"], c["i"], c["j"], c["m"], strict=True):
                sample, weight, label, own, node = block_members(m)
                near = [(float((sample[a] == sample[b]).mean()), a, int(b)) for a in range(len(m)) for b in open_pairs(sample, weight, label, own, band, i == j, a)]
                near.sort(key=lambda x: (-x[0], x[1], x[2]))
                sets = [shingles(h, table) for h in words_of([x["text"] for x in m])]
                for _, a, b in near:  # the likeliest first; classes joined on the way need no further link
                    if label[a] != label[b] and weighted_jaccard(*sets[a], *sets[b]) >= SIMILAR:
                        out["leader"].append(int(node[a]))
                        out["member"].append(int(node[b]))
                        label[label == label[b]] = label[a]
            return out

        return fn

    return store(map_batches(grouped.select("band", "i", "j", "m"), make, "leader long, member long"), "leftover-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id, kept (one row of each class), text_hash, same_rows (rows with this id and text)."""
    idf = docs.sparkSession.sparkContext.broadcast(shingle_idf(docs))
    sig = signatures(docs, idf)
    nodes = sig.groupBy("key_a", "key_b").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.min(F.struct("weight", "sample")).alias("s"))
    nodes = store(nodes.select("key_a", "key_b", "node", "first_id", "s.weight", "s.sample"), "nodes")
    rows = bucket_rows(nodes)
    pairs, met = hub_candidates(rows, nodes)
    links = verified(docs, pairs, nodes, idf)
    labels = components(links)
    rest = leftover_blocks(met, labels, nodes)
    if rest.limit(1).count():
        more = leftover_links(docs, rest, nodes, idf)
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    classes = nodes.join(labels, "node", "left").select("key_a", "key_b", "first_id", F.coalesce("label", "node").alias("label"))
    return name_classes(sig, store(classes, "classes"))


def name_classes(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Name each class by its smallest id; the row of that id (the first of repeated rows) is kept."""
    by = sig.groupBy("key_a", "key_b", "doc_id", "text_hash").agg(F.count("*").alias("same_rows"), F.min("rid").alias("rid"))
    size = classes.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    size = store(size, "class-names")
    k = size.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    named = rows_and_attach(classes, size, "label", "n", k["k"], k["n"], 48, F.xxhash64("key_a", F.lit(3))).select("key_a", "key_b", "label", "class_id")
    spread = store(by, "class-rows")
    texts = spread.groupBy("key_a", "key_b").agg(F.count("*").alias("n"))
    named = store(texts.join(named, ["key_a", "key_b"]).withColumn("key", F.struct("key_a", "key_b")).select("key", "n", "label", "class_id"), "classes")
    m = named.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    out = rows_and_attach(spread.withColumn("key", F.struct("key_a", "key_b")), named, "key", "n", m["k"], m["n"], 64, F.struct(F.xxhash64("rid").alias("key_a"), F.xxhash64("rid", F.lit(1)).alias("key_b")))
    out = store(out, "classed")
    first = out.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("rid").alias("first_rid"))
    out = out.join(first.select(F.col("first_rid").alias("__r")), F.col("rid") == F.col("__r"), "left")
    return out.select("doc_id", "class_id", F.col("__r").isNotNull().alias("first"), "text_hash", "same_rows")


def per_row(found: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row: of repeated rows of the kept text one is kept."""
    r = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("same_rows"))))
    return r.select("doc_id", "class_id", (F.col("first") & (F.col("k") == 1)).alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each class, columns unchanged."""
    d, t = fresh(docs, "__d", "__t")
    gone = found.where("not first").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))
    gone = store(gone, "dropped")
    gone = F.broadcast(gone) if gone.count() * 32 <= BROADCAST_BYTES else gone
    key: Column = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (key == F.col(t)), "left_anti")
    again = found.where("first and same_rows > 1").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))
    if not again.limit(1).count():
        return left
    match = left["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(left["text"], F.lit(""))) == F.col(t))
    return left.join(again, match, "left_anti").unionByName(left.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
