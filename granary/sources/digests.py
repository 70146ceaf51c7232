"""Digests of files and of content, made on executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once.
CHUNK = 8 << 20
#: Hexadecimal digits of a line's digest in one lane of the content's; sums of lanes fit a decimal of 38 digits for any number of lines.
LANE, LANES = 15, 4


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, bytes) of the files below a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", glob) if glob else files
    return files.load(path).select("path", F.col("length").alias("bytes"))


def open_store(path: str) -> tuple[Any, str]:
    """The file system of a path and the path in it, for a task.  Local, HDFS, S3 and GCS paths; others can't be opened outside of Spark's readers."""
    from urllib.parse import unquote

    from pyarrow import fs

    if "://" not in path:
        path = f"file://{path.removeprefix('file:')}"
    return (fs.LocalFileSystem(), unquote(path.removeprefix("file://"))) if path.startswith("file://") else fs.FileSystem.from_uri(path)


def chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    """A file's bytes in order, ``size`` at a time."""
    store, place = open_store(path)
    with store.open_input_stream(place, buffer_size=0) as file:
        while block := file.read(size):
            yield block


def stream_digest(path: str, size: int = CHUNK) -> tuple[int, str]:
    """(bytes, SHA-256) of a file of any length; one chunk is in memory."""
    sha, n = hashlib.sha256(), 0
    for block in chunks(path, size):
        sha.update(block)
        n += len(block)
    return n, sha.hexdigest()


def file_digests(spark: SparkSession, path: str, glob: str | None = None, size: int = CHUNK) -> DataFrame:
    """(path, bytes, sha256) of the files below a path, a file a task at a time, streamed in chunks, so that a file may have any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                n, digest = stream_digest(p, size)
                yield pa.RecordBatch.from_pydict({"path": [p], "bytes": [n], "sha256": [digest]})

    return list_files(spark, path, glob).select("path").mapInArrow(run, "path string, bytes long, sha256 string")


def content_digest(numbered: DataFrame, number: str = "line", value: str = "value") -> DataFrame:
    """One row (lines, digest): a digest of numbered lines, the same however Spark cuts and orders them.

    Each line's SHA-256, with its number, gives lanes that are summed, first where the lines are; the digest is that of the count and the sums.
    """
    own: Column = F.sha2(F.concat(F.col(number).cast("string"), F.lit(":"), F.coalesce(F.col(value), F.lit(""))).cast("binary"), 256)
    lane = lambda k: F.conv(F.substring("_d", 1 + k * LANE, LANE), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(lane(k)), F.lit(0).cast("decimal(38,0)")).alias(f"_{k}") for k in range(LANES)]
    out = numbered.select(own.alias("_d")).agg(F.count("*").alias("lines"), *sums)
    parts = F.concat_ws(":", F.col("lines").cast("string"), *(F.col(f"_{k}").cast("string") for k in range(LANES)))
    return out.select("lines", F.sha2(parts.cast("binary"), 256).alias("digest"))
