"""Tables by name: create, insert, update, delete, describe.

Files are rewritten as a whole or by partition, so a change is a select with a
condition, written beside the old table and put in its place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """A Parquet table; range partitions are a column of the range."""
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def range_partition(value: Column, width: float) -> Column:
    """Start of the range that a value is in, to partition by."""
    return F.floor(value / width) * width


def insert(rows: DataFrame, name: str, make_key: Callable[[DataFrame], DataFrame] | None = None, unique_by: Sequence[str] = ()) -> None:
    """Append rows: unknown columns are dropped, missing ones null, rows whose key the table has are left out."""
    spark = rows.sparkSession
    table = spark.table(name)
    rows = make_key(rows) if make_key else rows
    if unique_by:
        rows = rows.dropDuplicates(list(unique_by)).join(table.select(*unique_by), list(unique_by), "left_anti")
    rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes]).write.insertInto(name)


def replace(df: DataFrame, name: str) -> None:
    """Put a result in the place of a table, partitioned as it was.

    The old table is renamed first and dropped last: a failure in between
    leaves it as NAME__old, and a rename that fails is taken back.
    """
    spark = df.sparkSession
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    df.write.mode("overwrite").partitionBy(*parts).saveAsTable(f"{name}__new")
    spark.sql(f"DROP TABLE IF EXISTS {name}__old")
    rename(spark, name, f"{name}__old", bool(parts))
    try:
        rename(spark, f"{name}__new", name, bool(parts))
    except Exception:
        rename(spark, f"{name}__old", name, bool(parts))
        raise
    spark.sql(f"DROP TABLE {name}__old")


def rename(spark: SparkSession, old: str, new: str, partitioned: bool) -> None:
    """Rename a table; its partitions are looked up anew, since the catalog keeps their former places."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    if partitioned:
        spark.sql(f"MSCK REPAIR TABLE {new} SYNC PARTITIONS")


def updated(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def deleted(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def update(spark: SparkSession, name: str, where: Column, values: dict[str, Column]) -> None:
    replace(updated(spark.table(name), where, values), name)


def delete(spark: SparkSession, name: str, where: Column) -> None:
    replace(deleted(spark.table(name), where), name)


def select(spark: SparkSession, name: str, columns: Sequence[str] = ("*",), where: str | None = None, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    df = spark.table(name)
    df = df.where(where) if where else df
    df = df.orderBy(*order) if order else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns)


def describe(spark: SparkSession, name: str) -> dict[str, str]:
    return dict(spark.table(name).dtypes)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def append_stack(tables: Sequence[DataFrame], constants: Sequence[dict], path: str) -> None:
    """Tables one below the other with constant columns each, as one CSV folder."""
    out = None
    for t, c in zip(tables, constants, strict=True):
        t = t.withColumns({k: F.lit(v) for k, v in c.items()})
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    out.write.option("header", True).csv(path)
