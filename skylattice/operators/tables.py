"""Column, row and set operators of a catalog table.

Missing values are NULL inside the library; :func:`nan_to_null` converts NaN
once, where data come in, because Spark takes NaN as the largest number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from skylattice.plans.storage import checkpointed


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating column becomes NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first name of an alias list that the table has (case matters)."""
    return next((n for n in names if n in df.columns), None)


def column_index(df: DataFrame, names: Sequence[str], fill: int | None = None) -> list[int | None]:
    """1-based positions of columns; a missing one is ``fill``, or an error without it."""
    missing = [n for n in names if n not in df.columns]
    if missing and fill is None:
        raise KeyError(f"no columns {missing}")
    return [df.columns.index(n) + 1 if n in df.columns else fill for n in names]


def insert_column(df: DataFrame, name: str, value: Column, at: int) -> DataFrame:
    """A new column at a 1-based position."""
    cols = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*cols[: at - 1], value.alias(name), *cols[at - 1 :])


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Units as column metadata."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"unit": units[c]}) if c in units else F.col(f"`{c}`") for c in df.columns])


def units_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["unit"] for f in df.schema.fields if "unit" in f.metadata}


def predicate(text: str) -> Column:
    """A boolean expression such as ``mag1>8 & mag2<10`` as a column.

    Only the logical signs differ from SQL; Spark parses and resolves the rest,
    so a column name inside another word is never replaced.
    """
    for pattern, word in ((r"&+", " AND "), (r"\|+", " OR "), (r"~=", "<>"), (r"==", "="), (r"~", " NOT ")):
        text = re.sub(pattern, word, text)
    return F.expr(text)


def query(df: DataFrame, text: str) -> DataFrame:
    return df.where(predicate(text))


def query_range(df: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Rows inside every inclusive range."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]))


def query_fun(df: DataFrame, tests: dict[str, Callable[[Column], Column]], every: bool = True) -> DataFrame:
    """Rows for which all (or any) of the column tests hold."""
    flags = [f(F.col(c)) for c, f in tests.items()]
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), flags))


def last_range(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """1-based number of the last inclusive range that holds the value, 0 if none."""
    out = F.lit(0)
    for i, (lo, hi) in enumerate(ranges, 1):
        out = F.when(value.between(lo, hi), F.lit(i)).otherwise(out)
    return out


def in_ranges(value: Column, ranges: Sequence[tuple[float, float]], every: bool = True) -> Column:
    flags = [value.between(lo, hi) for lo, hi in ranges]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), flags)


def and_missing(a: Column, b: Column) -> Column:
    """AND in which a missing side is neutral; both missing is true."""
    return F.coalesce(a, F.lit(True)) & F.coalesce(b, F.lit(True))


def or_missing(a: Column, b: Column) -> Column:
    """OR in which a missing side is neutral; both missing is false."""
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def select_rows(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Rows named by an index table (pos, key): its order and repeats are kept, a missing key gives an all-null row."""
    rest = [c for c in df.columns if c != key]
    return index.select("pos", F.col(key).alias("__k")).join(df, F.col("__k") == F.col(key), "left").select("pos", F.col("__k").alias(key), *rest)


def insert_rows(df: DataFrame, other: DataFrame, key: str, blank_others: bool = False) -> DataFrame:
    """Rows of ``other`` replace those of the same key; with ``blank_others`` all others become null."""
    rest = [c for c in df.columns if c != key]
    o = other.select(F.col(key).alias("__k"), F.struct(*rest).alias("__o"))
    j = df.join(o, F.col(key) == F.col("__k"), "left")
    keep = lambda c: F.lit(None) if blank_others else F.col(c)
    return j.select(key, *[F.when(F.col("__k").isNotNull(), F.col("__o")[c]).otherwise(keep(c)).alias(c) for c in rest])


def crop(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], shift: bool = True) -> DataFrame:
    """Rows in an inclusive box (xmin, xmax, ymin, ymax); shifted so that the corner is (1, 1)."""
    x0, x1, y0, y1 = box
    d = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return d.withColumns({x: F.col(x) - x0 + 1, y: F.col(y) - y0 + 1}) if shift else d


def merge(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Tables one below the other, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(*columns) for t in tables])


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both tables hold the same rows equally often."""
    cols = a.columns
    n = a.withColumn("__s", F.lit(1)).unionByName(b.select(*cols).withColumn("__s", F.lit(-1))).groupBy(*cols).agg(F.sum("__s").alias("d"))
    return n.agg(F.coalesce(F.max(F.abs("d")) == 0, F.lit(True)).alias("is_equal"))


def flip(df: DataFrame, order: str) -> DataFrame:
    """Rows in reverse order of a position column, renumbered from 1."""
    top = df.agg(F.max(order).alias("__m"))
    return df.join(F.broadcast(top)).withColumn(order, F.col("__m") - F.col(order) + 1).drop("__m")


def header_table(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long (file, key, value) headers as one row a file."""
    return headers.where(F.col("key").isin(list(keys))).groupBy("file").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in an order over all of them, without one task that gets them all.

    Range partitions are sorted one by one and number their own rows; the
    counts of the partitions before are added.  The sorted rows are
    checkpointed, so that counts and numbers come from the same ranges.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids count up from 2^33 times the number of the partition
    d = checkpointed(d.withColumn("__id", F.monotonically_increasing_id()))
    d = d.withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND((1 << 33) - 1))
    first = d.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__o", F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    # a row a partition: as many as tasks
    return d.join(F.broadcast(first), "__p").withColumn(name, F.coalesce("__o", F.lit(0)) + F.col("__i") + 1).drop("__id", "__p", "__i", "__c", "__o")


def dense_codes(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with their rank from 1 in sorted order."""
    return numbered(df.select(value).distinct(), [value], name)


def alias_value(names: Sequence[str]) -> Column:
    """The first non-null of several alias columns."""
    return F.coalesce(*[F.col(n) for n in names])


def group_numbers(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Groups of equal key tuples: how many members, the smallest and the largest one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first k rows, per group if there are group columns."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def select_by(df: DataFrame, tests: dict[str, list | tuple], every: bool = True) -> DataFrame:
    """Rows by properties: a list of values, or an inclusive range as a pair."""
    flags = [F.col(c).between(*v) if isinstance(v, tuple) else F.col(c).isin(v) for c, v in tests.items()]
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), flags))


def insert_at(df: DataFrame, rows: DataFrame, pos: str) -> DataFrame:
    """Rows put before given places (from 0) of a table in the order of ``pos``; all places are counted anew from 0."""
    both = rows.withColumn("__side", F.lit(0)).unionByName(df.withColumn("__side", F.lit(1)))
    rest = [c for c in df.columns if c != pos]
    return numbered(both, [pos, "__side", *rest], "__n").withColumn(pos, F.col("__n") - 1).drop("__n", "__side")
