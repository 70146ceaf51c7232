"""Helpers to run Arrow batch functions inside DataFrame plans."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, schema: str, batch: Callable[[pa.RecordBatch], Iterable[dict]], *columns: str | Column) -> DataFrame:
    """Each non-empty batch of the columns through a function that yields dicts of column values.

    Values are lists, numpy or Arrow arrays, by the names of the schema.
    """
    source = df.select(*columns) if columns else df
    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                if b.num_rows:
                    for out in batch(b):
                        yield to_batch(out, target)
        finally:
            give_back()

    return source.mapInArrow(run, kind)


def map_partition(df: DataFrame, schema: str, partition: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], *columns: str | Column) -> DataFrame:
    """As map_batches, over the iterator of a whole partition's batches."""
    source = df.select(*columns) if columns else df
    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in partition(b for b in batches if b.num_rows):
                yield to_batch(out, target)
        finally:
            give_back()

    return source.mapInArrow(run, kind)


def give_back() -> None:
    """Return a finished task's memory to the system: Spark keeps workers for later tasks, beside other executors' processes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def to_batch(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    def column(v, kind):
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        if isinstance(v, pa.Array):
            return v if v.type == kind else v.cast(kind)
        return pa.array(v, type=kind)

    return pa.RecordBatch.from_arrays([column(values[f.name], f.type) for f in schema], schema=schema)

