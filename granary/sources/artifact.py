"""Sharded vector artifacts: one row per record, metadata and vectors committed together, in files of bounded bytes, with tables as their index.

states/  the rows, ordered by (rank, shard, offset); a file holds many shards, a shard lies in one file
index/   a row per shard: where it is and how many rows it has
files/   a row per file: bytes and SHA-256
manifest.json  the run, its totals and reports; its size doesn't depend on the shards
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tensors import has_shape, is_finite, offending_layers, packed_finite
from ..operators.integrity import metadata_problems, problem_summary
from ..operators.packing import shard_name
from .digests import file_digests, list_files, open_store
from .jsonl import exists, read_document, write_document
from .tables import stage_boundary

VECTORS = ("embedding", "hidden_states")
METADATA = "source_index long, input_sha256 string, token_count long, bucket int, truncated_tokens int, label int, rank int, shard long, offset long"
#: Bytes of a file of vectors.
FILE_BYTES = 128 << 20
#: Bytes of token ids that a task reads to write a file.
TOKEN_BYTES = 256 << 20
#: Bytes of a row beside its vectors.
ROW_BYTES = 160


def vector_types(layers: int | None, dtype: str) -> dict[str, str]:
    """Column types of the vectors: floats, or bfloat16 packed as two bytes a value."""
    one = "binary" if dtype == "bfloat16" else "array<float>"
    return {"embedding": one} | ({"hidden_states": f"array<{one}>"} if layers else {})


def states_schema(layers: int | None, dtype: str) -> StructType:
    return StructType.fromDDL(METADATA + "".join(f", {name} {kind}" for name, kind in vector_types(layers, dtype).items()))


def record_bytes(width: int, layers: int | None, dtype: str) -> int:
    return ROW_BYTES + width * (1 + (layers or 0)) * (2 if dtype == "bfloat16" else 4)


def lay_out_shards(df: DataFrame, rows: int, each: int, file_bytes: int = FILE_BYTES, tokens: float = 0) -> DataFrame:
    """df in tasks of whole shards, in the order of rank, shard and offset: each task's file has some ``file_bytes``, or fewer where its rows,
    of ``tokens`` tokens each at most, would else be more than TOKEN_BYTES of ids to read."""
    tasks = max(1, -(-rows * each // file_bytes), math.ceil(rows * 4 * tokens / TOKEN_BYTES))
    return df.repartitionByRange(tasks, "rank", "shard").sortWithinPartitions("rank", "shard", "offset")


def write_shards(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows that are laid out already.  Metadata and vectors are one commit, so no vectors can be left without metadata."""
    df.write.mode(mode).parquet(f"{path}/states")


def read_shards(spark: SparkSession, path: str, columns: StructType | None = None) -> DataFrame:
    """The artifact's rows; with columns, by that schema, where a file without one of them gives nulls."""
    return (spark.read.schema(columns) if columns else spark.read).parquet(f"{path}/states")


def shard_path() -> Column:
    return F.concat(F.lit("states/"), shard_name(F.col("shard"), F.col("rank")))


def shard_rows(df: DataFrame) -> DataFrame:
    """(rank, shard, path, rows): no vector is read."""
    return df.groupBy("rank", "shard").agg(F.count("*").alias("rows")).withColumn("path", shard_path())


def shard_index(df: DataFrame) -> DataFrame:
    """(rank, shard, path, file, first_row, rows) of a scan of states: where each shard's rows are.  Small columns and rows' numbers are read, no vectors.

    A shard whose rows lie in several files has a row for each.
    """
    places = df.select("rank", "shard", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_row"))
    return places.groupBy("rank", "shard", "file").agg(F.min("_row").alias("first_row"), F.count("*").alias("rows")).select("rank", "shard", shard_path().alias("path"), "file", "first_row", "rows")


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, keys, types) of the files of states, from their footers alone, read by the executors; keys are the vectors' columns in order."""
    own = {x.split()[0] for x in METADATA.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for b in batches:
            for p in b.column(0).to_pylist():
                store, place = open_store(p)
                try:
                    with store.open_input_file(place) as f:
                        meta = parquet.read_metadata(f)
                    schema = meta.schema.to_arrow_schema()
                    vectors = sorted(f.name for f in schema if f.name not in own)
                    row = (meta.num_rows, vectors, [str(schema.field(v).type).replace(": float not null", ": float").replace("element: ", "").replace("item: ", "") for v in vectors])
                except (pa.ArrowInvalid, OSError) as e:
                    row = (-1, ["unreadable"], [str(e)[:200]])
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([row[0]]), pa.array([row[1]], pa.list_(pa.string())), pa.array([row[2]], pa.list_(pa.string()))], names=["path", "rows", "keys", "types"])

    files = list_files(spark, f"{path}/states", "*.parquet").select("path").mapInArrow(run, "path string, rows long, keys array<string>, types array<string>")
    return files.select(file_name(F.col("path")).alias("file"), "path", "rows", "keys", "types")


def write_index(spark: SparkSession, path: str) -> None:
    """The tables index and files of the states that are there."""
    shard_index(read_shards(spark, path)).repartitionByRange("rank", "shard").sortWithinPartitions("rank", "shard").write.mode("overwrite").parquet(f"{path}/index")
    contents = file_digests(spark, f"{path}/states", "*.parquet").select(file_name(F.col("path")).alias("file"), "bytes", "sha256")
    held = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("rows").alias("rows"))
    contents.join(held, "file", "left").select("file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), "sha256").write.mode("overwrite").parquet(f"{path}/files")


def build_manifest(spark: SparkSession, path: str, config: dict[str, Any], writers: int, reports: Sequence[dict[str, Any]] = ()) -> dict[str, Any]:
    """Config and totals of an artifact whose index is written."""
    index, files = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/files")
    rows, shards = index.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_distinct("rank", "shard")).first()
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    totals = {"records": rows, "tensor_rows": rows, "num_shards": shards, "num_files": n, "bytes": size}
    return config | {"status": "complete", "writer_count": writers, "index": "index", "files": "files", "rank_reports": sorted(reports, key=lambda r: r["rank"])} | totals


def vector_problems(df: DataFrame, width: int, layers: int | None = None, dtype: str = "float32") -> DataFrame:
    """(rule, subject, detail) of rows whose vectors have another shape or values that aren't finite, by shard; null vectors have another shape."""
    own, states = F.col("embedding"), F.col("hidden_states")
    if dtype == "bfloat16":
        fits = lambda v: F.coalesce(F.octet_length(v) == 2 * width, F.lit(False))
        checks = [("embedding_shape", ~fits(own)), ("embedding_finite", ~packed_finite(own))]
        if layers:
            shape = F.coalesce((F.size(states) == layers) & ~F.exists(states, lambda v: ~fits(v)), F.lit(False))
            checks += [("hidden_shape", ~shape), ("hidden_finite", ~packed_finite(packed_layers(states)))]
    else:
        checks = [("embedding_shape", ~has_shape(own, (width,))), ("embedding_finite", ~is_finite(own))]
        if layers:
            checks += [("hidden_shape", ~has_shape(states, (layers, width))), ("hidden_finite", F.size(offending_layers(states)) > 0)]
    marks = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks]))
    return df.select(shard_path().alias("subject"), F.explode(marks).alias("rule")).groupBy("rule", "subject").agg(F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("detail")).select("rule", "subject", "detail")


def packed_layers(states: Column) -> Column:
    """All layers' packed bytes, one after the other."""
    return F.unhex(F.array_join(F.transform(states, lambda v: F.hex(v)), ""))


def footer_problems(spark: SparkSession, path: str, layers: int | None, dtype: str) -> tuple[DataFrame, DataFrame]:
    """(path, file, good) of all files, and problems of those whose vectors have other columns or types than the artifact's."""
    # How Arrow prints the columns' types.
    printed = {"array<float>": "list<float>", "array<array<float>>": "list<list<float>>", "binary": "binary", "array<binary>": "list<binary>"}
    wanted = vector_types(layers, dtype)
    keys, types = sorted(wanted), [printed[wanted[k]] for k in sorted(wanted)]
    seen = stage_boundary(footers(spark, path).withColumn("good", (F.array_join("keys", ",") == ",".join(keys)) & (F.array_join("types", ",") == ",".join(types))))
    detail = F.concat(F.lit("columns "), F.array_join(F.zip_with("keys", "types", lambda k, t: F.concat_ws(" ", k, t)), ", "))
    return seen.select("path", "file", "good"), seen.where("NOT good").select(F.lit("vector_columns").alias("rule"), F.col("file").alias("subject"), detail.alias("detail"))


def validate_artifact(spark: SparkSession, path: str, width: int, layers: int | None = None, report: str | None = None, dtype: str = "float32", digests: bool = True) -> dict[str, Any]:
    """All problems of an artifact, gathered, not raised; the report has totals, histograms and, per rule, the first problem and their number.

    Files whose vectors have other columns or types are a problem and are left out of the totals.  Shards of the index that have no rows, rows of shards
    that it doesn't list (missing_shard), and files whose bytes or digest differ from those listed are problems; ``digests=False`` leaves the digests out.
    """
    manifest = read_document(spark, f"{path}/manifest.json")
    out: dict[str, Any] = {"artifact": path, "writer_count": manifest["writer_count"], "records_per_rank": {}, "bucket_counts": {}, "records": 0, "shards": 0, "files": 0}
    problems: list[str] = []
    if not exists(spark, f"{path}/states"):
        problems.append("states: missing")
    else:
        seen, found = footer_problems(spark, path, layers, dtype)
        bad = [r.path for r in seen.where("good").select("path").collect()] if not seen.where("NOT good").isEmpty() else None
        # A scan of all files fails on another type, so where some files are bad the good ones are named: as many names as Spark's driver lists for any scan.
        scan = spark.read.schema(states_schema(layers, dtype))
        df = scan.parquet(f"{path}/states") if bad is None else scan.parquet(*bad) if bad else spark.createDataFrame([], states_schema(layers, dtype))
        held = stage_boundary(shard_index(df)) if bad is None or bad else None
        listed = spark.read.parquet(f"{path}/index")
        problem = lambda rule, subject, detail: F.struct(F.lit(rule).alias("rule"), subject.alias("subject"), detail.alias("detail"))
        if held is not None:
            kept = held.groupBy("path").agg(F.sum("rows").alias("_held"))
            told = listed.groupBy("path").agg(F.sum("rows").alias("_told"))
            both = kept.join(told, "path", "full_outer")
            lost = F.array(
                F.when(F.col("_held").isNull(), problem("missing_rows", F.col("path"), F.lit("the index lists it"))),
                F.when(F.col("_held") != F.col("_told"), problem("index_rows", F.col("path"), F.concat(F.col("_held").cast("string"), F.lit(" rows, not "), F.col("_told").cast("string")))),
            )
            found = found.unionByName(both.select(F.inline(F.array_compact(lost))))
            tensors = kept.join(told, "path", "left_semi").select(F.col("path").alias("shard"), F.col("_held").alias("rows"))
            metadata = df.select("source_index", "rank", shard_path().alias("shard"), "offset")
            found = found.unionByName(metadata_problems(metadata, tensors, manifest["writer_count"], manifest["records"], manifest["tensor_rows"]))
            found = found.unionByName(vector_problems(df, width, layers, dtype))
            out["records"], out["shards"] = tensors.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
            counts = stage_boundary(df.groupBy("rank", "bucket").count())
            for name, column in (("records_per_rank", "rank"), ("bucket_counts", "bucket")):
                out[name] = {r[0]: r[1] for r in counts.groupBy(column).agg(F.sum("count")).orderBy(column).collect()}
        now = file_digests(spark, f"{path}/states", "*.parquet") if digests else list_files(spark, f"{path}/states", "*.parquet").withColumn("sha256", F.lit(None).cast("string"))
        now = now.select(file_name(F.col("path")).alias("file"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
        files = spark.read.parquet(f"{path}/files").join(now, "file", "full_outer")
        other = F.when(F.col("_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "not listed").when(F.col("bytes") != F.col("_bytes"), "other bytes").when(F.col("sha256") != F.col("_sha"), "other digest")
        found = found.unionByName(files.select(other.alias("detail"), "file").where("detail IS NOT NULL").select(F.lit("damaged_file").alias("rule"), F.col("file").alias("subject"), "detail"))
        out["files"] = seen.count()
        problems += problem_summary(found)
    out |= {"valid": not problems, "problems": problems}
    if report:
        write_document(spark, report, out)
    return out
