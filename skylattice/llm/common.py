"""What the operators of this subpackage share: shared storage and bounded joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size (bytes) of a join side that is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: A key that holds more than 1/HOT_PARTS of the rows is hot; there are fewer than HOT_PARTS such keys.
HOT_PARTS = 1024
#: Folder of the ``scratch`` block that is open, if any.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the warehouse (local mode: a temporary folder)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="skylattice-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{_SCRATCH.get() or shared_dir(df.sparkSession)}/skylattice-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """Keep the tables stored within the block in one shared folder, which is removed at its end.

    What is made from them must be written by then: results are read lazily.
    """
    path = f"{shared_dir(spark)}/skylattice-scratch-{label}-{uuid.uuid4().hex}"
    outer = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rows_and_attach(left: DataFrame, right: DataFrame, key: str, weight: str, n_right: int, total: int, row_bytes: int, salt: Column) -> DataFrame:
    """Left join of ``right`` (unique, non-null ``key``) that no hot key can skew.

    ``weight`` counts the left rows of each key, ``n_right`` and ``total`` are
    the rows of ``right`` and of ``left``.  A small ``right`` (a checked size)
    is broadcast.  Otherwise the fewer than HOT_PARTS keys with over
    total/HOT_PARTS left rows are broadcast, and the rest is an equi-join in
    which ``salt`` stands for the key of rows that are already answered.
    """
    cols = [c for c in right.columns if c not in (key, weight)]
    right = right.select(key, weight, F.struct(*cols).alias("__v"))
    if n_right * row_bytes <= BROADCAST_BYTES:
        out = left.join(F.broadcast(right.drop(weight)), key, "left")
    else:
        hot = F.col(weight) > max(1, total // HOT_PARTS)
        top = right.where(hot).select(F.col(key).alias("__hk"), F.col("__v").alias("__hv"))
        rest = right.where(~hot).select(F.col(key).alias("__ck"), F.col("__v").alias("__cv"))
        out = left.join(F.broadcast(top), F.col(key) == F.col("__hk"), "left")
        out = out.withColumn("__jk", F.when(F.col("__hk").isNull(), F.col(key)).otherwise(salt))
        out = out.join(rest, (F.col("__jk") == F.col("__ck")) & F.col("__hk").isNull(), "left")
        out = out.withColumn("__v", F.coalesce("__hv", "__cv")).drop("__hk", "__hv", "__ck", "__cv", "__jk")
    return out.select(*[c for c in out.columns if c != "__v"], *[F.col("__v")[c].alias(c) for c in cols])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that a table does not have: each name, with underscores added as needed (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Bind an expression once inside a larger one: body(value), with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(labels: DataFrame, label: str, usable: Column, max_labels: int) -> DataFrame:
    """At most about ``max_labels`` labelled ids (``doc_id``, ``y`` 0/1) for fitting, the same ones at every run.

    Rows with a null id or label are left out; an id labelled both ways counts
    as 1.  Which ids stay is decided by a hash of the id, so that the bound
    does not favour any part of the table.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(usable).groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    n = clean.count()
    if n > max_labels:
        clean = clean.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(max_labels / n * (1 << 20)))
    return clean


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) of sampled ids (doc_id, y; few enough to be broadcast): of an id with several rows, the text of the least hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of a value as text, modulo m (null: null)."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % m


def attach_wide(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join with a ``right`` of wide rows (unique ``key``).

    ``hot`` (column ``key``, fewer than HOT_PARTS rows) names the keys that
    hold many left rows: their right rows are copied to ``salts`` places and
    the left rows dealt over them by ``spread``.  Only those few ids are broadcast.
    """
    mark = F.broadcast(hot.select(F.col(key).alias("__hot")))
    a = left.join(mark, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))).drop("__hot")
    b = right.join(mark, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("__hot")
    return a.join(b, [key, "__salt"]).drop("__salt")
