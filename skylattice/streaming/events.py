"""Streaming counterparts of the event operators; each runs the same plan as its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def table_stream(spark: SparkSession, path: str, schema: StructType, files_at_a_time: int = 100) -> DataFrame:
    """A Parquet table as a stream: the files of a folder, or one file alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return folder_stream(spark, path, schema, files_at_a_time=files_at_a_time)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return folder_stream(spark, folder, schema, name, files_at_a_time)


def folder_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_at_a_time: int = 100) -> DataFrame:
    """New Parquet files of a folder, each processed once (by the checkpoint), oldest first."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def _until(events: DataFrame, late: str | None) -> DataFrame:
    return events if late is None else events.withWatermark("ts", late)


def tumbling(events: DataFrame, size: str, late: str | None, by: str) -> DataFrame:
    """Count and sum of value by key and window; state is dropped ``late`` after the window (None: never, and no row is too late)."""
    return _until(events, late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sliding(events: DataFrame, size: str, slide: str, late: str | None, by: str) -> DataFrame:
    """As tumbling, for windows that overlap."""
    return _until(events, late).groupBy(F.window("ts", size, slide), by).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def sessions(events: DataFrame, gap: str, late: str | None, by: str) -> DataFrame:
    return _until(events, late).groupBy(F.session_window("ts", gap).alias("window"), by).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str | None, keys: list[str]) -> DataFrame:
    """First event of each key that arrives.

    Without ``late`` every key is kept in state, and files may come in any
    order.  With it a key is forgotten ``late`` after its time, which bounds
    the state, but an event older than that is dropped even if its key is new.
    """
    return events.dropDuplicates(keys) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, write it as Parquet, and return it."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _batches(stream: DataFrame, change: Callable[[DataFrame], DataFrame], schema: StructType, out: str, checkpoint: str, mode: str) -> DataFrame:
    """Write every batch to a folder of its own (written anew if the batch is run again) and return all of them, with their number as ``batch``."""
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: change(b).write.mode("overwrite").parquet(f"{out}/batch={i}"))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(out)


def run_latest(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return what a batch would: every key with its last value, open windows too.

    Each batch writes only the keys that it changed.  Aggregations take no
    watermark here, since that would drop rows of an earlier time in later files.
    """
    d = _batches(stream, lambda b: b, stream.schema, out, checkpoint, "update")
    values = [c for c in stream.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, *[F.col("__v")[c].alias(c) for c in values])


def run_sessions(events: DataFrame, gap: str, by: str, out: str, checkpoint: str) -> DataFrame:
    """Sessions of all that is there, in whatever order files come: (window, by, n).

    Each batch is cut into sessions of its own; a closing pass joins those of a
    key that overlap.  No state is kept while the stream runs.
    """
    parts = lambda b: b.groupBy(F.session_window("ts", gap).alias("window"), by).agg(F.count("*").alias("n"))
    d = _batches(events, parts, StructType([*parts(events.sparkSession.createDataFrame([], events.schema)).schema]), out, checkpoint, "append")
    w = Window.partitionBy(by).orderBy("window.start", "window.end", "batch")
    ended = F.max("window.end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", F.coalesce((F.col("window.start") >= ended).cast("int"), F.lit(1)))
    d = d.withColumn("__session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(by, "__session").agg(F.min("window.start").alias("start"), F.max("window.end").alias("end"), F.sum("n").alias("n"))
    return d.select(F.struct("start", "end").alias("window"), by, "n")


class VisitCounter(StatefulProcessor):
    """Visits of a key: number, first and last time, kept in state; a timer ends those that were not seen for a while."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getValueState("visits", "n long, first timestamp, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, first, last = self.visits.get() if self.visits.exists() else (0, None, None)
        for part in rows:
            n += len(part)
            low, high = part["ts"].min(), part["ts"].max()
            first = low if first is None else min(pd.Timestamp(first), low)
            last = high if last is None else max(pd.Timestamp(last), high)
        self.visits.update((n, first, last))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame({"key": [key[0]], "n": [n], "first": [first], "last": [last], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, first, last = self.visits.get()
        self.visits.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [n], "first": [first], "last": [last], "ended": [True]})

    def close(self) -> None:
        pass


VISITS = "key long, n long, first timestamp, last timestamp, ended boolean"


def visits(events: DataFrame, by: str, idle: tuple[str, int] | None = None) -> DataFrame:
    """Visit counts of each key after every batch (update mode): key, n, first, last, ended.

    ``idle`` = (lateness of the watermark, milliseconds): a key that has no
    event for so long in event time ends, and its next event begins anew.  A
    null key has no counter.  Needs the RocksDB state store.
    """
    d = events.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias("key"), "ts")
    d = d if idle is None else d.withWatermark("ts", idle[0])
    return d.groupBy("key").transformWithStateInPandas(VisitCounter(None if idle is None else idle[1]), VISITS, "Update", "None" if idle is None else "EventTime")


def run_visits(events: DataFrame, by: str, out: str, checkpoint: str) -> DataFrame:
    """Visits of each key over all that is there, by keyed state, whatever the order of the files."""
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_latest(visits(events, by), ["key"], out, checkpoint)
    finally:
        spark.conf.set(name, before)


def ingest(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every batch of new files to a callback; a batch that fails is handed over again at the next start."""
    stream.writeStream.outputMode(mode).foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
