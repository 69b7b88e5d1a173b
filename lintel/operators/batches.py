"""Python functions of one row that give several, in Arrow batches.

Rows go to and from plain lists: with batches of few rows a pandas frame for each
costs more than the work on its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def flat_map(rows: DataFrame, make: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """The rows (schema; keys left out are null) that make gives for each of rows, whose columns are its arguments."""
    fields, shape = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(f).to_pylist() for f in fields), strict=True)
            yield pa.RecordBatch.from_pylist([r for v in values for r in make(*v)], schema=shape)

    return rows.mapInArrow(run, schema)
