"""Query registry: a name, a Spark callable and (where SQL can say it) DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries; each module owns one and the entry point merges them."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
