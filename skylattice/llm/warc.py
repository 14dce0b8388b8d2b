"""WARC archives: write, split by Spark's text reader, verify the chain of records.

Reading splits a file at every record magic, also at one inside a payload.
Each such candidate gives its own offset and, from its Content-Length, that of
its successor.  Pointer jumping from the start of each file keeps the
candidates that the chain of true records reaches; the text of the others goes
back into the payload that holds it.

Defined results: a null payload counts as empty; among equal payloads the
smallest id is the response (a null id never is one beside an id that is not
null) and repeated rows of it are responses too; a file that does not begin
with a record has none; a record whose name holds no page number has a null
page_id beside its record_id; a revisit that states no size has none.

Files named .gz, compressed whole or record by record, are read as the bytes
they hold; such a file cannot be split, so one task reads it.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches
from skylattice.llm.common import rows_and_attach, store

# Fixed values of the format.
MAGIC, VERSION, END = "WARC/1.", "0\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SEP = END + MAGIC
BAD_URL = {"\r": "%0D", "\n": "%0A"}


def sha1_base32(payload: Column) -> Column:
    """Bare base32 of the SHA-1: five hex digits are four letters."""
    hexed = F.sha1(payload)
    letters = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """One record per row of (page_id, url, html) under ``path``.

    Payloads of ``min_payload`` bytes and more are stored once: rows equal to
    an earlier page become revisits.  Only digests held by several rows are
    joined back; a hot payload is a few pre-aggregated rows a task.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    p = p.withColumn("n", F.octet_length("body").cast("bigint")).withColumn("digest", sha1_base32(F.encode("body", "UTF-8")))
    same = p.where(F.col("n") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    same = store(same, "warc-copies")
    size = same.agg(F.count("*").alias("k"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()
    p = rows_and_attach(p, same, "digest", "copies", size["k"], size["n"], 96, F.sha2(F.concat_ws(":", "page_id", "url"), 256))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n") >= min_payload)
    url = F.col("url")
    for c, escaped in BAD_URL.items():
        url = F.replace(url, F.lit(c), F.lit(escaped))
    page_name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC + VERSION), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", page_name("page_id")), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", page_name("first_id")), line("X-Payload-Bytes", F.col("n").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit("\r\n"),
    )
    record = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("body")))
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def parse_header(raw: bytes) -> dict[str, str] | None:
    """Fields of a record header after the magic (lower-case names), or None if it is none."""
    version, _, raw = raw.partition(b"\r\n")
    fields = {}
    for line in raw.split(b"\r\n") if version in (b"0", b"1") else (b"",):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def base32_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


FRAGMENT = "file string, block long, rel long, size long, start long, succ long, body_at int, body_bytes long, complete boolean, record_type string, page_id long, record_id string, url string, refers_to long, refers_to_id string, claimed string, claimed_bytes long, digest string, raw binary"


def fragments(spark: SparkSession, paths: list[str], keep_raw: bool) -> DataFrame:
    """One row per stretch between two magics, with offsets relative to its input split."""
    lines = spark.read.option("lineSep", SEP).text(paths)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def make():
        place: dict[tuple[str, int], int] = {}

        def fn(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {f.split()[0]: [] for f in FRAGMENT.split(", ")}
            for value, file, block in zip(cols["value"], cols["file"], cols["block"], strict=True):
                value = value or b""
                rel = place.get((file, block), 0)
                place[file, block] = rel + len(value) + len(SEP)
                opening = block == 0 and rel == 0
                skip = len(MAGIC) if opening and value.startswith(MAGIC.encode()) else 0
                start = rel if opening else rel - len(MAGIC)
                stop = value.find(b"\r\n\r\n", skip)
                stop = len(value) if stop < 0 else stop  # then the payload itself begins with a magic
                head = parse_header(value[skip:stop]) if skip or not opening else None
                row = dict.fromkeys(out)
                row |= {"file": file, "block": block, "rel": rel, "size": len(value) + len(SEP), "start": start, "complete": False, "raw": value if keep_raw else None}
                if head is not None:
                    n, body_at = int(head["content-length"]), stop + 4
                    body = value[body_at : body_at + n]
                    complete = len(body) == n and value[body_at + n :] in (b"", b"\r\n\r\n")
                    row |= {"succ": rel + body_at + n + len(END), "body_at": body_at, "body_bytes": n, "complete": complete, "record_type": head.get("warc-type"), "page_id": page_of(head.get("warc-record-id", "")), "url": head.get("warc-target-uri"), "refers_to": page_of(head.get("warc-refers-to", ""))}
                    row |= {"record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to")}
                    row |= {"claimed": head.get("warc-payload-digest", "").removeprefix("sha1:"), "claimed_bytes": int(x) if (x := head.get("x-payload-bytes", "")).isdigit() else None, "digest": base32_of(body) if complete else None}
                for k, v in row.items():
                    out[k].append(v)
            return out

        return fn

    return map_batches(lines, make, FRAGMENT)


def split_chains(links: DataFrame) -> DataFrame:
    """Stored: one row per input split (file, block) with its candidates ``s`` [{start, succ}] by start; a split bounds how many they are."""
    one = links.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("start", "succ"))).alias("s"))
    return store(one, "warc-splits")


def exits(s: list[dict]) -> list[int | None]:
    """Where the chain from each candidate of a split leaves it; null if it ends at a place inside that is no candidate."""
    at, last = {x["start"]: i for i, x in enumerate(s)}, s[-1]["start"]
    out: list[int | None] = [None] * len(s)
    for i in range(len(s) - 1, -1, -1):
        succ = s[i]["succ"]
        out[i] = out[at[succ]] if succ in at else succ if succ > last else None
    return out


def jumped(state: DataFrame) -> DataFrame:
    """Pointer jumping over (file, start, jump, reached): what is reached marks where it jumps to; a round doubles the reach and is written to the shared folder."""
    state = store(state, "warc-chain")
    known = state.where("reached").count()
    while known:
        b = state.select(F.col("file").alias("bf"), F.col("start").alias("bs"), F.col("jump").alias("bj"))
        j = state.join(b, (F.col("file") == F.col("bf")) & (F.col("jump") == F.col("bs")), "left")
        j = j.select("file", F.explode(F.array(F.struct("start", F.col("bj").alias("jump"), "reached"), F.when(F.col("reached") & F.col("bs").isNotNull(), F.struct(F.col("bs").alias("start"), F.lit(None).cast("bigint").alias("jump"), F.lit(True).alias("reached"))))).alias("x"))
        state = store(j.where("x is not null").select("file", "x.*").groupBy("file", "start").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")), "warc-chain")
        now = state.where("reached").count()
        if now == known:
            break
        known = now
    return state.where("reached").select("file", "start")


def reachable(links: DataFrame) -> DataFrame:
    """The (file, start) of ``links`` (file, block, start, succ) on the chain from start 0 of each file.

    Chains are contracted inside each input split first, so pointer jumping
    goes over the few candidates at which some chain enters a split, and takes
    about log2(splits of a file) rounds.  The chains from the entries that it
    reaches are then followed inside their splits.
    """
    splits = split_chains(links)

    def contract():
        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("file", "start", "jump")}
            for file, s in zip(c["file"], c["s"], strict=True):
                out["file"] += [file] * len(s)
                out["start"] += [x["start"] for x in s]
                out["jump"] += exits(s)
            return out

        return fn

    ways = store(map_batches(splits.select("file", "s"), contract, "file string, start long, jump long"), "warc-ways")
    targets = ways.where("jump is not null").select("file", F.col("jump").alias("start")).distinct()
    entries = ways.join(targets, ["file", "start"], "left_semi").where("start > 0").unionByName(ways.where("start = 0"))
    found = jumped(entries.select("file", "start", "jump", (F.col("start") == 0).alias("reached")))
    # an entry lies in the split whose candidates it is among
    of_split = links.select("file", "block", "start").join(found, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.collect_list("start").alias("entries"))

    def follow():
        def fn(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("file", "start")}
            for file, s, entries in zip(c["file"], c["s"], c["entries"], strict=True):
                succ, seen = {x["start"]: x["succ"] for x in s}, set()
                for at in entries:
                    while at in succ and at not in seen:
                        seen.add(at)
                        at = succ[at]
                out["file"] += [file] * len(seen)
                out["start"] += seen
            return out

        return fn

    return map_batches(splits.join(of_split, ["file", "block"]).select("file", "s", "entries"), follow, "file string, start long")


def placed(f: DataFrame) -> DataFrame:
    """Stored fragments with ``start`` and ``succ`` counted from the start of the file: the sizes of the splits before are added."""
    blocks = f.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    return f.join(blocks, ["file", "block"]).withColumn("start", F.col("start") + F.col("base")).withColumn("succ", F.col("succ") + F.col("base"))


def read_warc(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    """Records of the archives: page_id, record_id, url, record_type, refers_to, refers_to_id, payload_bytes, payload_digest, digest_ok (and payload)."""
    f = placed(store(fragments(spark, paths, with_payload), "warc-fragments"))
    true = reachable(f.where("succ is not null").select("file", "block", "start", "succ"))
    true = store(f.join(true, ["file", "start"], "left_semi"), "warc-records")
    parts = true.where("not complete").select("file").distinct().limit(1).count()
    payload = F.expr("substring(raw, body_at + 1, cast(body_bytes as int))").alias("payload")
    out = true.where("complete").select(*RECORD, *([payload] if with_payload else []))
    if parts:
        out = out.unionByName(stitched(spark, paths, true, f, with_payload))
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("claimed")).otherwise(F.col("digest"))
    return out.select("page_id", "record_id", "url", "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"), F.when(revisit, F.col("refers_to_id")).alias("refers_to_id"), F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("body_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), (digest == F.col("claimed")).alias("digest_ok"), *(["payload"] if with_payload else []))


RECORD = ("record_type", "page_id", "record_id", "url", "refers_to", "refers_to_id", "claimed", "claimed_bytes", "digest", "body_bytes")


#: Files that may be named one by one to be read again; beyond that all are read and those needed are picked by a join.
NAMED_FILES = 1000


def stitched(spark: SparkSession, paths: list[str], true: DataFrame, f: DataFrame, with_payload: bool) -> DataFrame:
    """Records whose payload holds magics: their files are read again, only their stretches put together."""
    needed = store(true.where("not complete").select("file").distinct(), "warc-again")
    named = [r["file"] for r in needed.limit(NAMED_FILES + 1).collect()]
    again = named if len(named) <= NAMED_FILES else paths
    inside = f.join(true.select("file", "start"), ["file", "start"], "left_anti").select("file", "start", F.lit(False).alias("own"))
    pieces = true.where("not complete").select("file", "start", F.lit(True).alias("own")).unionByName(inside.join(needed, "file", "left_semi"))
    owner = F.last(F.when(F.col("own"), F.col("start")), True).over(Window.partitionBy("file").orderBy("start"))
    pieces = pieces.withColumn("owner", owner).where("owner is not null")
    raw = placed(store(fragments(spark, again, True), "warc-pieces")).select("file", "start", "raw")  # splits may differ from those of the first reading
    got = raw.join(pieces, ["file", "start"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("pieces"))
    head = true.where("not complete").select("file", F.col("start").alias("owner"), "body_at", *RECORD)
    schema = "record_type string, page_id long, record_id string, url string, refers_to long, refers_to_id string, claimed string, claimed_bytes long, digest string, body_bytes long" + (", payload binary" if with_payload else "")

    def make():
        def fn(cols: dict[str, list]) -> dict[str, list]:
            out = {k: cols[k] for k in RECORD}
            whole = [SEP.encode().join(p["raw"] for p in pieces)[at : at + n] for pieces, at, n in zip(cols["pieces"], cols["body_at"], cols["body_bytes"], strict=True)]
            out["digest"] = [base32_of(b) for b in whole]
            return out | ({"payload": whole} if with_payload else {})

        return fn

    return map_batches(head.join(got, ["file", "owner"]).drop("file", "owner"), make, schema)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5*(k//4)::INT + 1, 5))::INT >> (15 - 5*(k%4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
