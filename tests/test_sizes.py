"""What a task reads and holds stays bounded where the tables grow."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from granary.functions.tokenizer import merge_ids
from granary.plans import config, jobs, registry
from granary.sources import artifact, jsonl


def test_files_of_narrow_vectors_bound_the_tokens_a_task_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifact, "TOKEN_BYTES", 20_000)
    lines = spark.range(300, numPartitions=2).select(F.to_json(F.struct(F.array_join(F.transform(F.sequence(F.lit(0), 20 + F.col("id") % 200), lambda x: x.cast("string")), " ").alias("text"), F.lit("").alias("answer"))).alias("value"))
    lines.write.text(str(tmp_path / "in"))
    own = config.RunConfig(input=str(tmp_path / "in"), output=str(tmp_path / "out"), width=2, shard_size=8, batch_size=2, buckets=(64, 128))
    plan = jobs.plan_extraction(jsonl.load_rows(spark, own.input), own)
    assert plan.agg(F.max(F.size("token_ids"))).first()[0] == 128  # what a bucket cuts isn't shipped
    jobs.extract(spark, own)
    files = artifact.read_shards(spark, own.output).groupBy(F.input_file_name()).agg(F.sum(F.least("token_count", F.col("bucket"))).alias("n")).collect()
    assert len(files) > 3 and max(r.n for r in files) * 4 <= 2 * 20_000
    assert jobs.validate(spark, own)["valid"]


def test_the_token_ids_are_not_shuffled_to_count_buckets(spark, tmp_path):
    spark.range(40).select(F.to_json(F.struct(F.repeat(F.lit("w "), (F.col("id") * 5 + 1).cast("int")).alias("text"))).alias("value")).write.text(str(tmp_path / "in"))
    own = config.RunConfig(input=str(tmp_path / "in"), output=str(tmp_path / "out"), buckets=(64, 128))
    plan = jobs.plan_extraction(jsonl.load_rows(spark, own.input), own)
    sizes = jobs.bucket_sizes(plan)
    read = [x for x in sizes._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in x]
    assert read and not [x for x in read if "token_ids" in x]
    want = plan.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.size("token_ids")).alias("tokens"))
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, want.collect())) and sizes.count() == 2


def test_lines_that_the_artifacts_are_made_of_are_compressed(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words "), F.col("id")), 50).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    path = registry._written_lines(spark, str(tmp_path))
    held = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    lines = jsonl.read_lines(spark, path).select("line", F.get_json_object("value", "$.doc_id").cast("long"), F.octet_length("value")).collect()
    assert sorted(r[0] for r in lines) == [r[0] for r in sorted(lines, key=lambda r: r[1])] == list(range(500))
    assert held * 3 < sum(r[2] for r in lines)


def test_merged_ids_take_few_bytes_each(spark):
    ids = merge_ids(spark, {bytes([b]): b for b in range(256)}).func
    texts = pa.array(["ab " * 700] * 1000 + [None, ""])
    tracemalloc.start()
    out = ids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1002 and len(out.flatten()) == 2_100_000 and out[1001].as_py() == []
    assert peak < 7 * 2_100_000
