"""Fixed-width, IPAC and keyword text files as projections of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IPAC_TYPES = {"int": "int", "long": "bigint", "double": "double", "float": "float", "real": "double", "char": "string", "date": "string"}


def read_fixed_width(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, int, str]], skip_prefix: str | None = "#") -> DataFrame:
    """Columns (name, 1-based start, length, type); a field that does not parse is null."""
    lines = spark.read.text(path)
    if skip_prefix:
        lines = lines.where(~F.col("value").startswith(skip_prefix))
    return lines.where(F.trim("value") != "").select(*[F.trim(F.substring("value", s, n)).try_cast(t).alias(c) for c, s, n, t in columns])


def read_ipac(spark: SparkSession, path: str) -> DataFrame:
    """A table whose ``|`` header lines give names, types and column borders; ``null`` is missing."""
    head = [r["value"] for r in spark.read.text(path).where(F.col("value").startswith("|")).limit(2).collect()]
    borders = [i for i, c in enumerate(head[0]) if c == "|"]
    names = [head[0][a + 1 : b].strip() for a, b in zip(borders, borders[1:], strict=False)]
    kinds = [head[1][a + 1 : b].strip() for a, b in zip(borders, borders[1:], strict=False)] if len(head) > 1 else ["char"] * len(names)
    data = spark.read.text(path).where(~F.col("value").rlike(r"^[\\|]") & (F.trim("value") != ""))
    field = lambda a, b: F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("null"))
    return data.select(*[field(a, b).try_cast(IPAC_TYPES.get(k, "string")).alias(n) for n, k, a, b in zip(names, kinds, borders, borders[1:], strict=False)])


def read_header_text(spark: SparkSession, path: str) -> DataFrame:
    """``KEY = value / comment`` lines as (file, key, value, comment)."""
    v = F.col("value")
    rest = F.regexp_extract(v, r"^\s*[A-Za-z0-9_-]+\s*=\s*(.*)$", 1)
    quoted = F.regexp_extract(rest, r"^'((?:[^']|'')*)'", 1)
    plain = F.trim(F.regexp_extract(rest, r"^([^/]*)", 1))
    lines = spark.read.text(path).select(v, F.col("_metadata.file_name").alias("file")).where(v.rlike(r"^\s*[A-Za-z0-9_-]+\s*="))
    return lines.select("file", F.regexp_extract(v, r"^\s*([A-Za-z0-9_-]+)", 1).alias("key"), F.when(rest.startswith("'"), F.rtrim(F.regexp_replace(quoted, "''", "'"))).otherwise(plain).alias("value"), F.trim(F.regexp_extract(rest, r"/(.*)$", 1)).alias("comment"))


def grep(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Lines that contain a text, with the file they are in."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").contains(text))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, key, value) of ``key = value`` lines under ``[section]`` lines; ``;`` and ``#`` begin a comment.

    A section is one record (files are split before each opening bracket at
    the start of a line), so its lines need no order between tasks.
    """
    blocks = spark.read.option("lineSep", "\n[").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("b"))
    section = F.trim(F.regexp_extract(F.ltrim("b"), r"^\[?([^\]\n]*)\]", 1))
    d = blocks.select("file", section.alias("section"), F.explode(F.split("b", "\n")).alias("line"))
    pair = r"^\s*([^;#=\[\]\s][^=\[\]]*?)\s*=\s*(.*?)\s*$"
    return d.where(F.col("line").rlike(pair)).select("file", "section", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))


def read_object_blocks(spark: SparkSession, path: str, head: Sequence[tuple[str, str]], rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Light curves as text: a ``# ...`` line of an object's fields, then a line for each epoch.

    An object is one record, split at the ``#``, so a file may be read by many
    tasks; fields are (name, type), and what does not parse is null.
    """
    blocks = spark.read.option("lineSep", "\n#").text(path).select(F.split("value", "\n").alias("l"))
    words = lambda c: F.split(F.trim(F.regexp_replace(c, "^#", "")), r"\s+")
    d = blocks.select(words(F.get("l", F.lit(0))).alias("h"), F.explode(F.slice("l", 2, F.size("l"))).alias("line")).where(F.trim("line") != "")
    d = d.withColumn("w", words(F.col("line")))
    take = lambda a, fields: [F.get(a, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)]
    return d.select(*take("h", head), *take("w", rows))


def file_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(name, path, bytes) of the files whose name matches a regular expression; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("bytes")).where(name.rlike(pattern))


def read_delimited(spark: SparkSession, file: str, head_line: int = 2, start_line: int = 4, sep: str = "|", comment: str = "(", text: Sequence[str] = ()) -> DataFrame:
    """A delimited file whose names are in one of its first lines, as database clients print tables.

    Columns whose name holds one of the ``text`` parts stay text, all others
    are numbers (null where they do not parse).  Lines that begin with the
    comment mark, and those before start_line, are not rows.
    """
    lines = spark.read.text(file)
    top = [r.value for r in lines.limit(start_line - 1).collect()]  # the first lines of one file
    names = [x.strip() for x in top[head_line - 1].strip().strip(sep).split(sep)]
    trim = F.regexp_replace(F.trim("value"), f"^[{sep}]|[{sep}]$", "")
    rows = lines.where(~F.col("value").isin(top) & ~F.ltrim("value").startswith(comment) & F.col("value").contains(sep))
    parts = rows.select(F.split(trim, f"[{sep}]", -1).alias("p"))
    return parts.select(*[F.trim(F.get("p", F.lit(i))).alias(n) if any(t in n for t in text) else F.trim(F.get("p", F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(names)])


def file_rows(df: DataFrame) -> DataFrame:
    """(name, n): rows of every file that a table was read from."""
    return df.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
