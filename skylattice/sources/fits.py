"""FITS files through Spark's binaryFile reader: headers, images and binary tables.

Any file system that Spark reads will do; a file is one row until it is parsed
in a task.  Files are also built here (as bytes, one per group of rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BLOCK, CARD = 2880, 80
#: Fixed values of the format: pixel and column types.
BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
TFORM = {"L": ("S1", "boolean"), "X": ("u1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string"), "C": (">c8", "float"), "M": (">c16", "double"), "P": (">i4", ""), "Q": (">i8", "")}
#: Fixed values of the format: the zero point that marks an unsigned (or signed byte) column, and the Spark type that holds it.
UNSIGNED = {"B": (-128, "short"), "I": (1 << 15, "int"), "J": (1 << 31, "long"), "K": (1 << 63, "decimal(20,0)")}


def parse_card(card: str) -> tuple[str, str | None, str]:
    """(key, value as text, comment) of one header card."""
    key = card[:8].strip()
    if card[8:10] != "= ":
        return key, None, card[8:].strip()
    body = card[10:]
    if body.lstrip().startswith("'"):
        start = body.index("'") + 1
        end = start
        while (end := body.find("'", end)) >= 0 and body[end : end + 2] == "''":
            end += 2
        if end < 0:  # a quote that is not closed: the rest is the value
            return key, body[start:].replace("''", "'").rstrip(), ""
        return key, body[start:end].replace("''", "'").rstrip(), body[end + 1 :].partition("/")[2].strip()
    value, _, comment = body.partition("/")
    return key, value.strip(), comment.strip()


def hdus(content: bytes) -> Iterator[tuple[int, list[tuple[str, str | None, str]], int, int]]:
    """(number, cards, data offset, data bytes) of every header-data unit."""
    at, n = 0, 0
    while at + BLOCK <= len(content):
        cards, done = [], False
        while not done and at + BLOCK <= len(content):
            block = content[at : at + BLOCK].decode("ascii", "replace")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = parse_card(block[i : i + CARD])
                if card[0] == "END":
                    done = True
                    break
                if card[0]:
                    cards.append(card)
        h = {k: v for k, v, _ in cards}
        axes = [int(h[f"NAXIS{i}"]) for i in range(1, int(h.get("NAXIS") or 0) + 1)]
        size = abs(int(h.get("BITPIX") or 8)) // 8 * int(np.prod(axes)) + int(h.get("PCOUNT") or 0) if axes else 0
        yield n, cards, at, size
        at += -(-size // BLOCK) * BLOCK
        n += 1


def _map(files: DataFrame, fn, schema: str) -> DataFrame:
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                for columns in fn(row["path"], row["content"]):
                    yield pa.RecordBatch.from_pydict(columns, schema=out)

    return files.select("path", "content").mapInArrow(run, schema)


def binary_files(spark: SparkSession, path: str, glob: str = "*.fits") -> DataFrame:
    """(path, content, ..) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_headers(spark: SparkSession, path: str, glob: str = "*.fits") -> DataFrame:
    """Long table (file, hdu, key, value, comment) of all headers."""
    return headers_in(binary_files(spark, path, glob))


def headers_in(files: DataFrame) -> DataFrame:
    """read_headers for files that are rows (path, content) already."""

    def fn(file, content):
        rows = [(file, n, *c) for n, cards, _, _ in hdus(content) for c in cards]
        yield dict(zip(("file", "hdu", "key", "value", "comment"), map(list, zip(*rows, strict=True)) if rows else ([],) * 5, strict=True))

    return _map(files, fn, "file string, hdu int, key string, value string, comment string")


def read_images(spark: SparkSession, path: str, glob: str = "*.fits") -> DataFrame:
    """Long table (file, hdu, r, c, v) of all two-dimensional images; NaN becomes null."""
    return images_in(binary_files(spark, path, glob))


def images_in(files: DataFrame) -> DataFrame:
    """read_images for files that are rows (path, content) already."""

    def fn(file, content):
        for n, cards, at, size in hdus(content):
            h = {k: v for k, v, _ in cards}
            if h.get("NAXIS") != "2" or h.get("XTENSION") == "BINTABLE" or not size:
                continue
            ny, nx = int(h["NAXIS2"]), int(h["NAXIS1"])
            a = np.frombuffer(content, BITPIX[int(h["BITPIX"])], nx * ny, at).reshape(ny, nx)
            v = (a * float(h.get("BSCALE") or 1) + float(h.get("BZERO") or 0)).astype(float)
            for r in range(ny):
                yield {"file": [file] * nx, "hdu": [n] * nx, "r": [r] * nx, "c": list(range(nx)), "v": [None if np.isnan(x) else x for x in v[r].tolist()]}

    return _map(files, fn, "file string, hdu int, r int, c int, v double")


@dataclass(frozen=True)
class Field:
    """A column of a binary table."""

    name: str
    letter: str
    repeat: int
    item: str
    scale: float
    zero: float
    null: int | None

    @property
    def variable(self) -> bool:
        return self.letter in "PQ"

    @property
    def dtype(self) -> tuple:
        """Shape and numpy type of the cells as they are stored."""
        kind = TFORM[self.letter][0]
        if self.letter == "A":
            return (f"V{self.repeat}",)
        if self.letter == "X":
            return (kind, (-(-self.repeat // 8),))
        return (kind, (2,)) if self.variable else (kind, (self.repeat,))

    @property
    def spark_type(self) -> str:
        letter = self.item if self.variable else self.letter
        if letter == "A":
            return "string"
        of = TFORM[letter][1]
        if letter in UNSIGNED and (self.scale, self.zero) == (1, UNSIGNED[letter][0]):
            of = UNSIGNED[letter][1]
        elif letter in "BIJKED" and (self.scale, self.zero) != (1, 0):
            of = "double"
        return f"array<{of}>" if self.variable or self.repeat != 1 or letter in "XCM" else of

    def numbers(self, v: np.ndarray, letter: str) -> list:
        """Physical values of stored ones; undefined integers and NaN are null."""
        if letter == "L":
            return [{b"T": True, b"F": False}.get(x) for x in v.tolist()]
        if letter in "CM":
            return v.view(v.real.dtype).tolist()
        if letter in "ED":
            v = v.astype(float) * self.scale + self.zero if (self.scale, self.zero) != (1, 0) else v
            return [None if x != x else x for x in v.tolist()]
        raw = v.tolist()
        if (self.scale, self.zero) == (1, UNSIGNED[letter][0]):
            wide = Decimal if letter == "K" else int
            return [None if x == self.null else wide(x + int(self.zero)) for x in raw]
        if (self.scale, self.zero) != (1, 0):
            return [None if x == self.null else x * self.scale + self.zero for x in raw]
        return [None if x == self.null else x for x in raw]

    def cells(self, stored: np.ndarray, heap: bytes) -> list:
        """Values of all rows."""
        if self.variable:
            kind = np.dtype(TFORM[self.item][0])
            get = lambda n, at: heap[at : at + n].partition(b"\0")[0].decode("ascii", "replace").rstrip() if self.item == "A" else self.numbers(np.frombuffer(heap, kind, n, at), self.item)
            return [get(int(n), int(at)) for n, at in stored]
        if self.letter == "A":
            return [x.tobytes().partition(b"\0")[0].decode("ascii", "replace").rstrip() for x in stored]
        if self.letter == "X":
            return [np.unpackbits(x)[: self.repeat].astype(bool).tolist() for x in stored]
        flat = self.numbers(np.ascontiguousarray(stored).reshape(-1), self.letter)
        n = self.repeat * (2 if self.letter in "CM" else 1)
        return flat if n == 1 else [flat[i * n : (i + 1) * n] for i in range(len(stored))]


def table_fields(cards: list[tuple[str, str | None, str]]) -> list[Field]:
    h = {k: v for k, v, _ in cards}
    out = []
    for i in range(1, int(h["TFIELDS"]) + 1):
        form = h[f"TFORM{i}"].strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        letter, item = form[digits], form[digits + 1 : digits + 2]
        null = h.get(f"TNULL{i}")
        number = lambda key, other: float(str(h.get(key) or other).replace("D", "E"))
        out.append(Field(h.get(f"TTYPE{i}") or f"Var{i}", letter, int(form[:digits] or 1), item, number(f"TSCAL{i}", 1), number(f"TZERO{i}", 0), int(null) if null else None))
    return out


def table_of(content: bytes, hdu: int) -> tuple[dict, list[Field], int]:
    """(header, fields, place of the data) of one unit."""
    cards, at = next((c, at) for n, c, at, _ in hdus(content) if n == hdu)
    return {k: v for k, v, _ in cards}, table_fields(cards), at


def read_table(spark: SparkSession, path: str, hdu: int = 1, glob: str = "*.fits") -> DataFrame:
    """Rows of one binary-table unit of all files, with a column ``file``.

    The columns are those of the first file by name, whose headers are read in
    a task; whatever lies before the table may be of any size.  Scaled columns
    have their physical values, undefined integers and NaN are null, complex
    numbers are arrays of real and imaginary parts, bits arrays of booleans.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    first = files.select("path").orderBy("path").first()["path"]
    return tables_in(files, spark.read.format("binaryFile").load(first), hdu)


def tables_in(files: DataFrame, first: DataFrame, hdu: int = 1) -> DataFrame:
    """read_table for files that are rows (path, content) already; ``first`` is the row whose headers name the columns."""
    cards = "key string, value string, comment string"

    def head(file, content):
        rows = next(c for n, c, _, _ in hdus(content) if n == hdu)
        yield dict(zip(("key", "value", "comment"), map(list, zip(*rows, strict=True)), strict=True))

    # one file is one row, whose cards come in order
    fields = table_fields([tuple(r) for r in _map(first, head, cards).collect()])
    schema = "file string, " + ", ".join(f"`{f.name}` {f.spark_type}" for f in fields)

    def fn(file, content):
        h, own, at = table_of(content, hdu)
        rows, width = int(h["NAXIS2"]), int(h["NAXIS1"])
        a = np.frombuffer(content, np.dtype([(f"c{i}", *f.dtype) for i, f in enumerate(own)]), rows, at)
        start = at + int(h.get("THEAP") or rows * width)
        heap = content[start : at + rows * width + int(h.get("PCOUNT") or 0)]
        place = {f.name: i for i, f in enumerate(own)}
        yield {"file": [file] * rows, **{f.name: own[place[f.name]].cells(a[f"c{place[f.name]}"], heap) for f in fields}}

    return _map(files, fn, schema)


def card(key: str, value, comment: str = "") -> bytes:
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else str(value)
    return f"{key:<8}= {text:>20} / {comment}"[:CARD].ljust(CARD).encode("ascii", "replace")


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % BLOCK)


def image_bytes(image: np.ndarray, keys: dict | None = None) -> bytes:
    """A file with one double-precision image."""
    head = [card("SIMPLE", True), card("BITPIX", -64), card("NAXIS", 2), card("NAXIS1", image.shape[1]), card("NAXIS2", image.shape[0]), *[card(k, v) for k, v in (keys or {}).items()]]
    return padded(b"".join(head) + b"END".ljust(CARD), b" ") + padded(image.astype(">f8").tobytes())


def table_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A file with one binary table of long, double or text columns."""
    kinds = {k: ("K", ">i8") if v.dtype.kind in "iu" else ("D", ">f8") if v.dtype.kind == "f" else (f"{v.dtype.itemsize if v.dtype.kind == 'S' else v.astype('S').dtype.itemsize}A", v.astype("S").dtype.str) for k, v in columns.items()}
    a = np.empty(len(next(iter(columns.values()))), np.dtype([(k, t) for k, (_, t) in kinds.items()]))
    for k, v in columns.items():
        a[k] = v
    primary = padded(card("SIMPLE", True) + card("BITPIX", 8) + card("NAXIS", 0) + b"END".ljust(CARD), b" ")
    head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", a.dtype.itemsize), card("NAXIS2", len(a)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns))]
    for i, (k, (form, _)) in enumerate(kinds.items(), 1):
        head += [card(f"TTYPE{i}", k), card(f"TFORM{i}", form)]
    return primary + padded(b"".join(head) + b"END".ljust(CARD), b" ") + padded(a.tobytes())
