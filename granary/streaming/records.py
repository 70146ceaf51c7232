"""Structured Streaming over the record functions.  An extension: the batch jobs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import BUCKETS, assign_bucket
from ..functions.text import token_count
from ..operators.records import normalize_records, with_digest


def stream_records(spark: SparkSession, folder: str, view: str = "full", buckets: tuple[int, ...] = BUCKETS, late: str = "1 hour") -> DataFrame:
    """Normalized records of JSON files (source_index, at, value) that arrive in a folder, with digest and bucket.

    A key is emitted once; keys are forgotten when the watermark has passed them by ``late``, so state stays bounded.
    """
    rows = spark.readStream.schema("source_index long, at timestamp, value string").json(folder)
    once = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["source_index"])
    r = with_digest(normalize_records(once, view=view, strict=False).where("NOT rejected")).withColumn("token_count", token_count(F.col("text"))).where("token_count > 0")
    bucket, cut = assign_bucket(F.col("token_count"), buckets)
    return r.withColumn("bucket", bucket).withColumn("truncated_tokens", cut)
