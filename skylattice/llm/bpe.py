"""Byte-level BPE by tree concatenation.

Text that the pre-tokenizer does not split is cut into halves, quarters and
so on; the leaves are encoded in parallel and joined again.  At a join a
window of tokens on both sides is encoded anew and grows until its first token
is the left side's and its last the right side's.  Every adjacent token pair is
then one that BPE itself makes, which fixes the encoding of the whole.

Defined results: null text counts as empty (no tokens); repeated rows each get
their row; a special token's string in a text is that special token.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.arrow import map_batches

# The pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text from which its pieces are spread over tasks, and of a piece.
LONG, LEAF = 32768, 8192
#: White space after a character that is none always starts a pre-token, so a cut there changes nothing.
CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One tokenizer file in memory; built once in each Python worker."""

    def __init__(self, content: bytes, leaf: int = LEAF) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.enc = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.names = [str(i) for i in range(max([*ranks.values(), *self.special.values()]) + 1)]
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.leaf = leaf

    def segments(self, text: str) -> Iterable[tuple[str, bool]]:
        """(text, whether it is a special token)."""
        if self.at_special is None or not any(s in text for s in self.special):
            return ((text, False),) if text else ()
        return ((s, s in self.special) for s in self.at_special.split(text) if s)

    def pieces(self, text: str) -> Iterable[tuple[str, int]]:
        """Independent pieces of at most about a leaf: (piece, -1), or (part of a word, word number) where no cut is free."""
        word = 0
        for segment, special in self.segments(text):
            if special:
                yield segment, -2
                continue
            at = 0
            while at < len(segment):
                if len(segment) - at <= self.leaf:
                    yield segment[at:], -1
                    break
                if cut := CUT.search(segment, at + self.leaf // 2, at + self.leaf):
                    yield segment[at : cut.start()], -1
                    at = cut.start()
                    continue
                # no white space for half a leaf: go word by word up to the next free cut
                far = CUT.search(segment, at + self.leaf)
                stop = far.start() if far else len(segment)
                for token in self.words(segment[at:stop]):
                    if len(token) <= self.leaf:
                        yield token, -1
                    else:
                        for half in self.halves(token):
                            yield half, word
                        word += 1
                at = stop

    def words(self, text: str) -> Iterable[str]:
        import regex

        return (m.group() for m in regex.finditer(PATTERN, text))

    def halves(self, token: str) -> Iterable[str]:
        """Leaves of the tree that halves an unsplit word."""
        if len(token) <= self.leaf:
            return (token,)
        mid = len(token) // 2
        return (*self.halves(token[:mid]), *self.halves(token[mid:]))

    def encode_piece(self, piece: str, word: int) -> list[int]:
        if word == -2:
            return [self.special[piece]]
        return self.enc.encode_ordinary(piece) if word == -1 else self.enc._encode_single_piece(piece.encode())

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbouring parts of one word from theirs."""
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self.enc._encode_single_piece(self.enc.decode_bytes(a + b))
            whole_left, whole_right = width >= len(left), width >= len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]) and (len(window) > 1 or (whole_left and whole_right)):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def merge(self, parts: list[tuple[list[int], int]]) -> list[int]:
        """Ids of a text from its encoded pieces in order; parts of one word are joined pairwise, level by level."""
        out: list[int] = []
        i = 0
        while i < len(parts):
            ids, word = parts[i]
            i += 1
            if word >= 0:
                level = [ids]
                while i < len(parts) and parts[i][1] == word:
                    level.append(parts[i][0])
                    i += 1
                while len(level) > 1:
                    level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
                ids = level[0]
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf and (self.at_special is None or not self.at_special.search(text)):
            return self.enc.encode_ordinary(text)
        return self.merge([(self.encode_piece(p, w), w) for p, w in self.pieces(text)])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.enc.decode_bytes(ids).decode("utf-8", errors="replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        names = self.names
        return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_CODECS: dict[tuple[int, int], Codec] = {}


def codec(content: bytes, leaf: int) -> Codec:
    key = (hash(content), leaf)
    if key not in _CODECS:
        _CODECS[key] = Codec(content, leaf)
    return _CODECS[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded.

    The tokenizer file (a few MB) is read by the driver and broadcast.  Texts
    of up to ``long`` characters are encoded where they are read.  Longer ones
    are cut, their pieces spread over the tasks and put together again.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def result(c: Codec, doc_ids: list, every: Iterable[list[int]]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
        for ids in every:
            n, a, b = c.digests(ids)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(a)
            out["decoded_sha256"].append(b)
            if with_ids:
                out["ids"].append(ids)
                out["decoded"].append(c.decode(ids))
        return out

    def whole():
        c = codec(content.value, leaf)
        return lambda cols: result(c, cols["doc_id"], (c.encode(t) for t in cols["t"]))

    def cut():
        c = codec(content.value, leaf)

        def fn(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "kid", "at", "word", "piece")}
            for doc_id, kid, t in zip(cols["doc_id"], cols["kid"], cols["t"], strict=True):
                for at, (piece, word) in enumerate(c.pieces(t)):
                    for k, v in zip(out, (doc_id, kid, at, word, piece), strict=True):
                        out[k].append(v)
            return out

        return fn

    def encode_parts():
        c = codec(content.value, leaf)
        return lambda cols: {k: cols[k] for k in ("doc_id", "kid", "at", "word")} | {"ids": [c.encode_piece(p, w) for p, w in zip(cols["piece"], cols["word"], strict=True)]}

    def merge():
        c = codec(content.value, leaf)

        def fn(cols: dict[str, list]) -> dict[str, list]:
            doc_ids, every = [], []
            for doc_id, parts in zip(cols["doc_id"], cols["parts"], strict=True):
                rows = sum(p["at"] == 0 for p in parts)  # repeated rows send the same pieces
                one = list({p["at"]: (p["ids"], p["word"]) for p in parts}.values())
                doc_ids += [doc_id] * rows
                every += [c.merge(one)] * rows
            return result(c, doc_ids, every)

        return fn

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    short = map_batches(d.where(F.char_length("t") <= long), whole, schema)
    pieces = map_batches(d.where(F.char_length("t") > long).select("doc_id", F.sha2("t", 256).alias("kid"), "t"), cut, "doc_id long, kid string, at int, word int, piece string")
    spread = pieces.repartition(F.col("doc_id"), F.col("at"))
    parts = map_batches(spread, encode_parts, "doc_id long, kid string, at int, word int, ids array<int>")
    whole_again = parts.groupBy("doc_id", "kid").agg(F.array_sort(F.collect_list(F.struct("at", "word", "ids"))).alias("parts"))
    return short.unionByName(map_batches(whole_again.select("doc_id", "parts"), merge, schema))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, decoded for rows of doc_id, ids (null ids: empty text)."""
    content = encoded.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))

    def make():
        c = codec(content.value, LEAF)
        return lambda cols: {"doc_id": cols["doc_id"], "decoded": [c.decode(ids or []) for ids in cols["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, decoded string")
