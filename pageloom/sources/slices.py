"""Rows mapped by Python in small slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A slice has at most so many rows, and about so many bytes (a larger row is a slice of its own).
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def map_in_slices(rows: DataFrame, make: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows.mapInPandas(make, schema)``, but ``make`` gets slices of a batch: what it makes of pages (trees, tables, bodies
    as data addresses) is many times their size, and a task holds that of one slice only, whatever its input."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step).to_pandas(integer_object_nulls=True)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in make(slices(batches)):
            yield pa.RecordBatch.from_pandas(made, schema=kinds, preserve_index=False)

    return rows.mapInArrow(mapped, schema)
