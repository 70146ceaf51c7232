"""JSON lines with physical line numbers, JSON documents, file digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.packing import in_window

# The lines of the regression sample.
SAMPLE_POSITIONS = (7, 11, 16, 22, 25, 29, 84, 88)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): every physical line with its number from 0, over files in the order of their paths.

    A split's rows are contiguous in one task, so a line's number is its place in the split plus the lines of earlier splits;
    only one row per split is windowed and broadcast.  Line breaks are LF, CRLF and CR.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(F.broadcast(splits), ["_f", "_b"]).select((F.col("_before") + F.col("_m") - F.col("_first")).cast("long").alias("line"), "value")


def load_rows(spark: SparkSession, path: str, start: int = 0, most: int | None = None) -> DataFrame:
    """(source_index, value) of the lines in [start, start + most) that aren't blank; a blank line uses up its number.

    Raises if nothing is left.
    """
    rows = read_lines(spark, path).where(in_window(F.col("line"), start, most)).where(strip(F.col("value")) != "")
    rows = rows.select(F.col("line").alias("source_index"), "value")
    if rows.isEmpty():
        raise ValueError(f"no records selected from {path}")
    return rows


def read_objects(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines by a schema; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(path) if not isinstance(path, str) else path)


def positional_sample(lines: DataFrame, positions: Sequence[int] = SAMPLE_POSITIONS) -> DataFrame:
    """Lines at the given positions; raises if one of them doesn't exist."""
    out = lines.where(F.col("line").isin(*positions))
    found = out.count()
    if found != len(set(positions)):
        raise ValueError(f"expected {len(set(positions))} lines, found {found}")
    return out


def write_objects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compact JSON lines, characters as they are, nulls written; committed as a whole."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df's only column as compressed lines, a file a task; a reader can't split a file, so tasks must be of bounded bytes, as those of a sort are."""
    df.write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def json_digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def write_document(spark: SparkSession, path: str, value: Any) -> None:
    """A JSON document with sorted keys in any store: written beside its place, then renamed over it, so a reader sees the old one or the new one."""
    p, fs = _path(spark, path)
    beside = p.suffix(".tmp")
    out = fs.create(beside, True)
    out.write(bytearray((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    place = fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), place, options)


def read_document(spark: SparkSession, path: str) -> Any:
    """A JSON document; FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def completion_problems(spark: SparkSession, folder: str, start: int, end: int) -> list[str]:
    """How a prepared part's marker file and summary differ from those of a finished part with the source lines range(start, end)."""
    marker, summary = f"{folder}/SUCCESS", f"{folder}/summary.json"
    facts: dict[str, Any] = read_document(spark, summary) if exists(spark, summary) else {}
    facts = facts | {"marker": spark.read.text(marker, wholetext=True).first()[0].strip() if exists(spark, marker) else None}
    wanted = {"marker": "ok", "status": "complete", "source_range": [start, end]}
    return [f"{name}: found {facts.get(name)!r}, wanted {value!r}" for name, value in wanted.items() if facts.get(name) != value]
