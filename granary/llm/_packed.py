"""Exchanges of packed arrays: one row per task and target partition instead of one per record.

A row holds the records of one mapper that go to one part, column after column, so Spark's shuffle
moves and compresses long byte strings and the reducers read arrays without making objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import map_partition

SCHEMA = "kind int, part int, blob binary"

Rows = Iterable[tuple[int, int, bytes]]


def parts_of(df: DataFrame) -> int:
    """Parts of a packed exchange: the session's shuffle partitions, which grow with the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """Columns of all blobs' records, one after the other."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // sum(sizes), 0
        for i, (k, s) in enumerate(zip(kinds, sizes, strict=True)):
            out[i].append(np.frombuffer(b, k, n, at))
            at += n * s
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def deal(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """The records of each part as one blob."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.int16) if part.max() < 1 << 15 else part, kind="stable")  # of two bytes: by counting
    part = part[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield kind, int(part[s]), pack([c[s:e] for c in columns])


def emit(rows: Rows, most: int = 16 << 20) -> Iterator[dict]:
    """Rows as batches of bounded bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield dict(zip(("kind", "part", "blob"), zip(*held, strict=True), strict=True))
            held, size = [], 0
    if held:
        yield dict(zip(("kind", "part", "blob"), zip(*held, strict=True), strict=True))


def map_packed(df: DataFrame, partition: Callable[[Iterator[pa.RecordBatch]], Rows], *columns) -> DataFrame:
    return map_partition(df, SCHEMA, lambda batches: emit(partition(batches)), *columns)


def exchange(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part")


def blobs(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """All (part, blob) of a partition by kind."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for kind, part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out.setdefault(kind, []).append((part, blob))
    return out
