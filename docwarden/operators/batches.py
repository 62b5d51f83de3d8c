"""Columns worked out in Python beside the rows that they belong to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def appended(rows: DataFrame, name: str, kind: str, values: Callable[[dict[str, list]], list], of: list[str]) -> DataFrame:
    """rows with a column: values gets the columns `of` of an Arrow batch as lists. All other columns pass as they are, so that long numbers beside
    nulls stay whole numbers."""
    schema = StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = values({c: batch.column(c).to_pylist() for c in of})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)
