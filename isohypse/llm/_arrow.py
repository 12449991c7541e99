"""Arrow batches in, Arrow batches out: the shape of the operators that need Python."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, sliced: bool = False) -> DataFrame:
    """Applies fn, from a batch (or a slice of it) to a dict of columns, to all rows of df."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lambda batches: run(slices(batches) if sliced else batches), out)


_ROWS = 250  # rows that are Python objects at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most; gives the task's memory back after the last."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def give_back() -> None:
    """Returns a finished task's memory to the system: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
