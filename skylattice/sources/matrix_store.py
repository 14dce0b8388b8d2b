"""Matched sources stored by field: a wide base table and a folder for every field that was added later.

A read takes the columns it names and joins only the added fields among them;
a deleted field of the base is marked, and nothing is written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

KEYS = ("source", "e")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write(df: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Store matched sources, sorted by key within the files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/base")


def fields(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> list[str]:
    """Fields that can be read."""
    gone = set(_folders(spark, f"{path}/deleted"))
    base = [c for c in spark.read.parquet(f"{path}/base").columns if c not in keys]
    return sorted({c for c in base if c not in gone} | set(_folders(spark, f"{path}/added")))


def add(df: DataFrame, path: str, field: str, keys: Sequence[str] = KEYS) -> None:
    """Add or replace a field, given with its keys (one row a key)."""
    df.select(*keys, field).write.mode("overwrite").parquet(f"{path}/added/{field}")


def delete(spark: SparkSession, path: str, field: str) -> None:
    fs, p = _fs(spark, f"{path}/added/{field}")
    fs.delete(p, True)
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/deleted/{field}"))


def read(spark: SparkSession, path: str, wanted: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The keys of the base table with the wanted fields; a place without an added value is null."""
    unknown = set(wanted) - set(fields(spark, path, keys))
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    added = set(_folders(spark, f"{path}/added"))
    out = spark.read.parquet(f"{path}/base").select(*keys, *[c for c in wanted if c not in added])
    for c in wanted:
        if c in added:
            out = out.join(spark.read.parquet(f"{path}/added/{c}"), list(keys), "left")
    return out.select(*keys, *wanted)
