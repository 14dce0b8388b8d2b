"""Ranks, quantiles and joins of groups of any size.

A window or an exact percentile keeps a group in one task.  Groups are counted
first (partial counts of the keys alone); where one has over GROUP_ROWS rows,
range partitions of group and order number the rows instead, as many tasks as
the group needs.  Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from skylattice.plans.storage import checkpointed

#: Rows of a group that one task may hold in order.
GROUP_ROWS = 1 << 22

#: Copies of rows that a task of :func:`by_series` should meet.
COPY_ROWS = 1 << 19


def _in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored rows in the order of group and columns: ``__id`` counts them up within the range ``__p``.

    A digest of the row splits those that are equal in group and order.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    d = df.withColumn("__tie", F.xxhash64(*plain))
    d = d.repartitionByRange(*by, *order, "__tie").sortWithinPartitions(*by, *order, "__tie").drop("__tie")
    # ids count up from 2^33 times the number of the partition
    d = checkpointed(d.withColumn("__id", F.monotonically_increasing_id()))
    return d.withColumn("__p", F.shiftright("__id", 33))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group (0 for an empty table)."""
    return df.groupBy(*by).agg(F.count("*").alias("__c")).agg(F.max("__c")).first()[0] or 0


def in_one_task(df: DataFrame, by: Sequence[str], copies: int) -> DataFrame | None:
    """Rows of every group in one task, for work on ``copies`` of each row in keys that extend the group's: rows are shuffled, not their copies.

    Tasks are as many as keep the copies of one near COPY_ROWS.  None where a
    group is large.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("__c")).agg(F.max("__c").alias("most"), F.sum("__c").alias("rows")).first()
    if (sizes.most or 0) > GROUP_ROWS:
        return None
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(sizes.rows or 0) * copies // COPY_ROWS)), *by)


def by_series(df: DataFrame, by: Sequence[str], copies: int) -> DataFrame:
    """As :func:`in_one_task`; where a group is large the rows stay as they are, and sums combine before the shuffle."""
    dealt = in_one_task(df, by, copies)
    return df if dealt is None else dealt


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, size: str, largest: int | None = None) -> DataFrame:
    """Rows of every group numbered from 1 in an order (``name``), with the rows of the group (``size``).

    ``largest`` is a bound of the largest group, where it is known already.
    A null key is a group of its own.
    """
    if (largest_group(df, by) if largest is None else largest) <= GROUP_ROWS:
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn(size, F.count("*").over(w))
    d = _in_ranges(df, by, order)
    parts = d.groupBy(*by, "__p").agg(F.min("__id").alias("__f"), F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), (before - F.col("__f") + 1).alias("__shift"), F.sum("__c").over(w).alias(size))
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return d.join(parts, same).withColumn(name, F.col("__id") + F.col("__shift")).select(*df.columns, name, size)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, total: str, largest: int | None = None) -> DataFrame:
    """Sum of a value up to and with every row of a group in an order (``name``), and the sum of the group (``total``); nulls count nothing."""
    if (largest_group(df, by) if largest is None else largest) <= GROUP_ROWS:
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn(total, F.sum(value).over(w))
    d = _in_ranges(df, by, order)
    d = d.withColumn("__s", F.sum(value).over(Window.partitionBy(*by, "__p").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*by)
    parts = d.groupBy(*by, "__p").agg(F.sum(value).alias("__c"))
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.sum("__c").over(w).alias(total))
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return d.join(parts, same).withColumn(name, F.coalesce(F.col("__before") + F.col("__s"), "__s", "__before")).select(*df.columns, name, total)


def row_windows(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, largest: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window of their group in an order, for functions that look at most so many rows back and on.

    Rows get their number from 1 (``__i``) and ``__own``: the caller keeps rows
    that have it set once the window's columns are there, then drops both
    (:func:`own`).  Where a group is large, the window runs over blocks of it
    that hold copies of their neighbours' edges.
    """
    if (largest_group(df, by) if largest is None else largest) <= GROUP_ROWS:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("__i", F.row_number().over(w).cast("bigint")).withColumn("__own", F.lit(True)), w
    size = max(GROUP_ROWS, before, after)
    d = ranked(df, by, order, "__i", "__n", GROUP_ROWS + 1).drop("__n")
    place, block = (F.col("__i") - 1) % size, F.floor((F.col("__i") - 1) / size)
    copies = F.array_compact(F.array(block, F.when(place >= size - before, block + 1), F.when(place < after, block - 1)))
    d = d.withColumn("__home", block).withColumn("__block", F.explode(copies)).withColumn("__own", F.col("__block") == F.col("__home")).drop("__home")
    return d, Window.partitionBy(*by, "__block").orderBy("__i")


def own(df: DataFrame) -> DataFrame:
    """The rows themselves of :func:`row_windows`, without its columns."""
    return df.where("__own").drop("__own", "__i", "__block")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], largest: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation, nulls left out) of every group; a column for each name of ``shares``, and the count ``__n``."""
    d = df.where(F.col(value).isNotNull()).select(*by, value)
    if (largest_group(d, by) if largest is None else largest) <= GROUP_ROWS:
        return d.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(k) for k, q in shares.items()], F.count("*").alias("__n"))
    r = ranked(d, by, [value], "__i", "__n", GROUP_ROWS + 1)

    def at(q: float) -> Column:
        # the ranks on both sides of the place (n - 1) q, counted from 0
        near = 1 - F.abs(F.col("__i") - 1 - (F.col("__n") - 1) * q)
        return F.sum(F.when(near > 0, F.col(value) * near))

    return r.groupBy(*by).agg(*[at(q).alias(k) for k, q in shares.items()], F.first("__n").alias("__n"))


def spread_join(rows: DataFrame, few: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join of rows with a table of few rows a key, in which a key with very many rows is met by ``salts`` tasks."""
    a = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
