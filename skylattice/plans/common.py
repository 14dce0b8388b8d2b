"""Inputs that the registered plans share: sky catalogs, light curves and event times derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.spatial import sky
from skylattice.registry import table

#: Day number of a timestamp, the time axis of light curves.
DAY_SQL = "(epoch_us({c}) / 86400000000.0)"


def day(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 86400e6


def catalog(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return sky(table(spark, d, name).withColumnRenamed(key, "id"), "id").select("id", "ra", "dec")


def light_curve(spark: SparkSession, d: str) -> DataFrame:
    """Long (source, t, flux, err, id): a supplier's shipments."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("source"), day("l_shipdate").alias("t"), F.col("l_extendedprice").alias("flux"), (1 + F.col("l_tax") * F.col("l_extendedprice")).alias("err"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("bigint").alias("flags"))


LC_SQL = f"lc AS (SELECT l_suppkey AS source, {DAY_SQL.format(c='l_shipdate')} AS t, l_extendedprice AS flux, 1 + l_tax*l_extendedprice AS err, l_orderkey*10+l_linenumber AS id, l_linenumber::BIGINT AS flags FROM lineitem)"


def event_times(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, event_type, s, value): seconds since the epoch."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "value")


EV_SQL = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts)/1000000.0 AS s, value FROM events)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Columns rounded, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, digits) for c in cols})
