"""Row functions over Arrow batches: one small helper for the operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows handed to a function at a time, so that very long texts never pile up.
SLICE = 256


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply ``make()`` (called once a task) to slices of a partition given as column lists."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, SLICE).to_pydict()), schema=out)

    return df.mapInArrow(run, schema)
