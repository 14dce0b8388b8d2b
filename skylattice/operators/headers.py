"""Edits and tests of headers kept as a long table (file, key, value, comment)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_value(headers: DataFrame, key: str, value: str, case: bool = False) -> DataFrame:
    """(file, is_val): whether a key of the file has the value; false where the file has no such key."""
    v = F.col("value") == value if case else F.lower(F.trim("value")) == value.lower()
    return headers.groupBy("file").agg(F.coalesce(F.bool_or((F.col("key") == key) & v), F.lit(False)).alias("is_val"))


def has_type(headers: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(file, is_type): whether any of several keys has any of several synonymous values."""
    hit = F.col("key").isin(list(keys)) & F.lower(F.trim("value")).isin([k.lower() for k in kinds])
    return headers.groupBy("file").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("is_type"))


def with_values(headers: DataFrame, values: dict[str, str], add: bool = False) -> DataFrame:
    """Keys with new values; with ``add``, files without such a key get it."""
    new = F.col("value")
    for k, v in values.items():
        new = F.when(F.col("key") == k, F.lit(v)).otherwise(new)
    out = headers.withColumn("value", new)
    if not add:
        return out
    have = headers.groupBy("file").agg(F.collect_set(F.when(F.col("key").isin(list(values)), F.col("key"))).alias("have"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in values.items()]))
    missing = have.select("file", "have", pairs.alias("p")).where(~F.array_contains("have", F.col("p.key"))).select("file", "p.key", "p.value", F.lit("").alias("comment"))
    return out.unionByName(missing)


def without_keys(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return headers.where(~F.coalesce(F.col("key").isin(list(keys)), F.lit(False)))


def only_keys(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return headers.where(F.col("key").isin(list(keys)))


def with_rows(headers: DataFrame, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows (key, value, comment) added to every file."""
    new = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(c).alias("comment")) for k, v, c in rows])
    return headers.unionByName(headers.select("file").distinct().select("file", F.explode(new).alias("r")).select("file", "r.*"))
