"""Jobs: preparing parts, extracting layer states, validating, publishing, and running specs that may already be done."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import assign_bucket
from ..functions.tokenizer import merge_ids, read_ranks, word_ids
from ..operators import integrity, packing, records
from ..operators.inference import Producer, infer, stub_layers
from ..sources import artifact, stage_boundary
from ..sources.digests import file_digests
from ..sources.jsonl import SAMPLE_POSITIONS, completion_problems, exists, load_rows, positional_sample, read_document, read_lines, read_objects, write_document, write_objects
from ..sources.publish import is_published, publish, pull
from .config import RunConfig, completed_and_valid, guard_output

PART_SCHEMA = "source_index long, paper_split string, context string, question string, best_answer string, label int, answer_view string, text string"


def check_slots(spark: SparkSession, config: RunConfig) -> None:
    """Raises if the cluster has another number of task slots than the run expects; a single-process run expects one."""
    expected = 1 if config.debug_single_process and config.expected_slots is not None else config.expected_slots
    found = spark.sparkContext.defaultParallelism
    if expected is not None and found != expected:
        raise RuntimeError(f"expected {expected} task slots, found {found}: look at the cluster, or at expected_slots")


def plan_extraction(rows: DataFrame, config: RunConfig, done: DataFrame | None = None) -> DataFrame:
    """Records with the token ids that are used, bucket, rank, batch, shard and offset; those done already are left out and each rank's shards go on behind its own.

    Records are normalized and tokenized once, into the shared folder.  Ordinals, batches and shards are planned over keys and buckets alone, and joined to
    the records by key at the end.
    """
    spark = rows.sparkSession
    ids = word_ids if config.vocabulary is None else merge_ids(spark, read_ranks(spark, config.vocabulary))
    r = records.with_digest(records.normalize_records(rows, text_column=config.text_column, answer_column=config.answer_column, view=config.view))
    r = r.select("source_index", "input_sha256", "label", ids(F.col("text")).alias("token_ids")).withColumn("token_count", F.size("token_ids").cast("long"))
    bucket, cut = assign_bucket(F.col("token_count"), config.buckets)
    used = F.when(F.size("token_ids") > bucket, F.slice("token_ids", F.size("token_ids") - bucket + 1, bucket)).otherwise(F.col("token_ids"))
    # Where this session sorted the input, the sort's files go now, before the ids are shuffled.
    r = stage_boundary(r.withColumn("bucket", bucket).withColumn("truncated_tokens", cut).withColumn("token_ids", used), release=True)
    keys = packing.with_ordinal(r.select("source_index", "bucket"), "source_index", computed=False)
    keys = keys.select("source_index", "bucket", packing.rank_of(F.col("ordinal"), config.writers).alias("rank"))
    if done is not None:
        keys = integrity.remaining(keys, done)
    keys = packing.with_shards(keys, config.effective_batch, config.shard_size, by=["rank"])
    if done is not None:
        behind = done.groupBy("rank").agg((F.max("shard") + 1).cast("long").alias("_behind"))  # a row per writer
        keys = keys.join(F.broadcast(behind), "rank", "left").withColumn("shard", F.col("shard") + F.coalesce("_behind", F.lit(0))).drop("_behind")
    return stage_boundary(keys.drop("bucket")).join(r, "source_index")


def bucket_sizes(plan: DataFrame) -> DataFrame:
    """(bucket, n, tokens): records, and the mean of their tokens that are used; counted without their ids, which would be shuffled for it."""
    return plan.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.least("token_count", F.col("bucket"))).alias("tokens"))


def rank_reports(config: RunConfig, done: DataFrame | None, processed: dict[int, int], seconds: float) -> list[dict[str, Any]]:
    """Per writer: records assigned, done before, processed in this run, and the run's seconds."""
    before = {} if done is None else {r[0]: r[1] for r in done.groupBy("rank").count().collect()}  # a row per writer
    return [
        {"rank": k, "assigned_records": before.get(k, 0) + processed.get(k, 0), "previously_completed": before.get(k, 0), "processed_this_run": processed.get(k, 0), "elapsed_seconds": round(seconds, 3)} for k in range(config.writers)
    ]


def extract(spark: SparkSession, config: RunConfig, produce: Producer | None = None) -> dict[str, Any]:
    """Scan, normalize, tokenize, plan, infer batch by batch, write shards, index, manifest; the manifest is returned, and published if the run says so.

    Layers that are missing, too many, of another shape or not finite stop the run before their shard is committed.
    """
    config = config.checked(spark)
    check_slots(spark, config)
    planned = config.planned(spark)
    guard_output(spark, config, planned)
    began = time.time()
    done = stage_boundary(artifact.read_shards(spark, config.output).select("source_index", "rank", "shard")) if exists(spark, f"{config.output}/states") else None
    plan = plan_extraction(load_rows(spark, config.input, config.start_index, config.max_samples), config, done)
    layers, observed = config.layers or 0, Observation()
    sizes = bucket_sizes(plan).collect()  # a row per bucket
    # Shards are in the order of buckets, so some tasks' rows are all of the longest.
    laid = artifact.lay_out_shards(plan, sum(r.n for r in sizes), artifact.record_bytes(config.width, config.layers, config.dtype), tokens=max((r.tokens for r in sizes), default=0))
    states = infer(laid, produce or stub_layers(config.width, layers), config.width, layers, config.effective_batch, config.pad_id, config.dtype, config.norm)
    artifact.write_shards(states.observe(observed, *(F.count_if(F.col("rank") == k).alias(str(k)) for k in range(config.writers))), config.output)
    processed = {int(k): n for k, n in observed.get.items()}
    artifact.write_index(spark, config.output)
    reports = rank_reports(config, done, processed, time.time() - began)
    manifest = artifact.build_manifest(spark, config.output, planned, config.writers, reports)
    manifest |= {"world_size": config.world_size, "effective_batch_size": config.effective_batch, "embedding_shape": [config.width], "hidden_states_shape": [layers, config.width], "spark": spark.version, "token_position": "last; padded and cut on the left"}
    write_document(spark, f"{config.output}/manifest.json", manifest)
    return manifest


def validate(spark: SparkSession, config: RunConfig, digests: bool = True) -> dict[str, Any]:
    return artifact.validate_artifact(spark, config.output, config.width, config.layers, f"{config.output}/validation.json", config.dtype, digests)


@dataclass(frozen=True)
class PartSpec:
    name: str
    folder: str
    start: int
    end: int


def part_problems(spark: SparkSession, part: PartSpec, splits: Sequence[str], views: Sequence[str] = ("full", "fst")) -> tuple[dict[str, DataFrame], list[str]]:
    """The views of a prepared part, and what is wrong with it."""
    problems = [f"{part.name}: {p}" for p in completion_problems(spark, part.folder, part.start, part.end)]
    frames = {v: read_objects(spark, f"{part.folder}/{v}.jsonl", PART_SCHEMA) for v in views}
    for v, df in frames.items():
        n = df.count()
        if n != part.end - part.start:
            problems.append(f"{part.name}/{v}: {n} rows, not {part.end - part.start}")
        found = [
            integrity.row_problems(df, splits=splits, view=v).select(F.col("source_index").cast("string").alias("k"), "problem"),
            integrity.prompt_mismatches(df).select(F.col("source_index").cast("string").alias("k"), F.lit("text is not the prompt of its fields").alias("problem")),
            integrity.duplicates(df).select(F.col("source_index").cast("string").alias("k"), F.lit("source_index is there several times").alias("problem")),
            integrity.coverage_gaps(df, part.start, part.end).select(F.col("source_index").cast("string").alias("k"), "problem"),
        ]
        problems += [f"{part.name}/{v}: {r.problem}: {r.n} rows, the first is {r.k}" for r in integrity.problem_list(found).groupBy("problem").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("problem").collect()]
    first, second = (frames[v] for v in views[:2])
    differ = integrity.cross_view_mismatches(first, second, ["context", "paper_split"]).groupBy("column").agg(F.count("*").alias("n")).orderBy("column")
    problems += [f"{part.name}: {r.column} differs between views in {r.n} rows" for r in differ.collect()]
    return frames, problems


def prepared_before(spark: SparkSession, output: str, wanted: dict[str, Any]) -> dict[str, Any]:
    """The manifest of an output that is there, if it was made of the same parts and its files are as they were written; raises else."""
    manifest = read_document(spark, f"{output}/manifest.json")
    differ = [k for k, v in wanted.items() if manifest.get(k) != v]
    if differ or manifest.get("status") != "complete":
        raise FileExistsError(f"{output} holds another preparation: {', '.join(differ) or 'not complete'}")
    for f in manifest["files"]:
        if not exists(spark, f"{output}/{f['name']}") or file_set_digest(spark, f"{output}/{f['name']}") != f["sha256"]:
            raise FileExistsError(f"{output}/{f['name']} isn't what was written")
    return manifest


def file_set_digest(spark: SparkSession, path: str) -> str:
    """One digest of a folder's part files, of their digests in the order of their names."""
    parts = file_digests(spark, path, "part-*")
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), "").cast("binary"), 256)).first()[0]


def prepare_parts(
    spark: SparkSession, parts: Sequence[PartSpec], output: str, expected: dict[str, int], views: Sequence[str] = ("full", "fst"), overwrite: bool = False, reuse: bool = False, staging: str | None = None, keep_staging: bool = False
) -> dict[str, Any]:
    """Check all parts, join them and write one file set per view and split; the first problem stops before anything is written.

    An output that is there is refused, unless it may be overwritten, or reused: then it must be of the same parts, and its files' digests are compared.
    With a staging folder the parts are copied there first, checked and joined from there, and the copies deleted at the end unless they are kept.
    """
    from ..sources.jsonl import remove
    from ..sources.publish import copy_folder

    wanted = {"parts": [[p.name, p.start, p.end] for p in parts], "expected": expected, "views": list(views)}
    if exists(spark, f"{output}/manifest.json") and not overwrite:
        if reuse:
            return prepared_before(spark, output, wanted)
        raise FileExistsError(output)
    if staging is not None:
        for p in parts:
            copy_folder(spark, p.folder, f"{staging}/{p.name}")
        parts = [replace(p, folder=f"{staging}/{p.name}") for p in parts]
    checked = [part_problems(spark, p, list(expected), views) for p in parts]
    problems = [x for _, p in checked for x in p]
    if problems:
        raise ValueError("; ".join(problems))
    reports = []
    for v in views:
        whole = integrity.union_parts([frames[v] for frames, _ in checked])
        wrong = integrity.count_mismatches(whole, {(s,): n for s, n in expected.items()}, ["paper_split"]).collect()
        classes = integrity.label_histogram(whole, ["paper_split"]).orderBy("paper_split", "label").collect()
        if wrong or not all(r.both_classes for r in classes):
            raise ValueError(f"{v}: split counts {wrong or 'fit'}, labels {classes}")
        for s in expected:
            name = f"{v}_{s}.jsonl"
            write_objects(whole.where(F.col("paper_split") == s).orderBy("source_index"), f"{output}/{name}")
            reports.append({"name": name, "view": v, "split": s, "rows": expected[s], "labels": {str(r.label): r.n for r in classes if r.paper_split == s}, "sha256": file_set_digest(spark, f"{output}/{name}")})
    manifest = wanted | {"status": "complete", "files": reports, "rows": sum(r["rows"] for r in reports)}
    write_document(spark, f"{output}/manifest.json", manifest)
    if staging is not None and not keep_staging:
        for p in parts:
            remove(spark, p.folder)
    return manifest


QA_SCHEMA = "context string, question string, best_answer string, label int, source_split string"


def qa_problems(df: DataFrame, split: str, expected: int, pinned: str | None = None, path: str | None = None) -> list[str]:
    """What is wrong with a question-and-answer input: fields, split, labels, rows, classes, and the SHA-256 of the file at path, if one is pinned."""
    df = df.withColumn("source_index", F.monotonically_increasing_id())
    rows = integrity.row_problems(df, ("context", "question", "best_answer", "label")).groupBy("problem").agg(F.count("*").alias("n")).orderBy("problem").collect()
    out = [f"{r.problem}: {r.n} rows" for r in rows]
    other, n, classes = df.agg(F.count_if(~F.col("source_split").eqNullSafe(split)), F.count("*"), F.count_distinct(F.when(F.col("label").isin(0, 1), F.col("label")))).first()
    out += [f"source_split differs in {other} rows"] * bool(other) + [f"{n} rows, not {expected}"] * (n != expected) + ["both classes are needed"] * (classes != 2)
    if pinned is not None:
        if path is None:
            raise ValueError("a pinned digest needs the file's path")
        found = [r.sha256 for r in file_digests(df.sparkSession, path).limit(2).collect()]
        out += [f"digest is {', '.join(found) or 'missing'}, not {pinned}"] * (found != [pinned])
    return out


@dataclass(frozen=True)
class Preflight:
    """A small run that must be valid before full ones: the input's lines at fixed positions, in one bucket."""

    output: str
    positions: tuple[int, ...] = SAMPLE_POSITIONS
    bucket: int = 1024
    shard_size: int = 8


def run_preflight(spark: SparkSession, spec: RunConfig, gate: Preflight, produce: Producer | None = None, dry_run: bool = False) -> dict[str, Any]:
    """Extract and validate the gate's sample of a spec's input; its result is kept, keyed by the sample run's identity, and asked for again.

    Another input, option or code is another identity, so a stale result opens nothing.  Raises if the sample isn't valid.
    """
    own = replace(spec, input=f"{gate.output}/sample", output=f"{gate.output}/run", view="full", buckets=(gate.bucket,), shard_size=gate.shard_size, start_index=0, max_samples=None, overwrite=True, resume=False, push_to=None)
    if dry_run:
        return {"status": "would run", "records": len(gate.positions)}
    sample = positional_sample(read_lines(spark, spec.input), gate.positions)
    sample.coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(own.input)  # as many lines as positions
    own = own.checked(spark)
    key, place = own.planned(spark)["config_sha256"], f"{gate.output}/preflight.json"
    if exists(spark, place) and (before := read_document(spark, place)).get("run") == key and before.get("valid") is True:
        return before | {"status": "valid before"}
    extract(spark, own, produce)
    report = validate(spark, own)
    result = {"status": "valid" if report["valid"] else "invalid", "run": key, "valid": report["valid"], "records": report["records"], "problems": report["problems"]}
    write_document(spark, place, result)
    if not (report["valid"] and report["records"] == len(gate.positions)):
        raise ValueError(f"preflight: {report['records']} records, {report['problems']}")
    return result


def run_specs(
    spark: SparkSession, specs: Sequence[RunConfig], expected: Sequence[int], produce: Producer | None = None, only: Sequence[str] | None = None, overwrite: bool = False, dry_run: bool = False, preflight: Preflight | None = None, preflight_only: bool = False
) -> list[tuple[str, str]]:
    """Bring every spec to a valid artifact: valid ones of the same run are skipped, begun ones resumed, others run; each run is validated, then published.

    A preflight, made of the first spec's input, must be valid before any other run; preflight_only ends there.  dry_run tells what would be done.
    """
    done: list[tuple[str, str]] = []
    if preflight is not None:
        done.append((preflight.output, run_preflight(spark, specs[0], preflight, produce, dry_run)["status"]))
        if preflight_only:
            return done
    for spec, n in zip(specs, expected, strict=True):
        if only is not None and spec.output not in only:
            continue
        if not overwrite and completed_and_valid(spark, spec.output, n, spec.checked(spark).planned(spark)) and (spec.published is None or is_published(spark, spec.published)):
            done.append((spec.output, "skipped"))
            continue
        begun = not overwrite and exists(spark, f"{spec.output}/run_config.json")
        if dry_run:
            done.append((spec.output, "would resume" if begun else "would run"))
            continue
        own = replace(spec, resume=begun, overwrite=overwrite)
        extract(spark, own, produce)
        report = validate(spark, own)
        if not report["valid"]:
            raise ValueError(f"{spec.output}: {report['problems']}")
        if own.published is not None:
            publish(spark, own.output, own.published)
        done.append((spec.output, "resumed" if begun else "ran"))
    return done


def pull_specs(spark: SparkSession, specs: Sequence[RunConfig], root: str, only: Sequence[str] | None = None, digests: bool = True, dry_run: bool = False) -> list[dict[str, Any]]:
    """Copy published artifacts below a folder and validate the copies there; digests=False leaves the digests of both out.  All are looked at before the first problem raises."""
    out = []
    for spec in specs:
        if spec.published is None or (only is not None and spec.output not in only):
            continue
        target = f"{root.rstrip('/')}/{spec.published.rpartition('/')[2]}"
        row: dict[str, Any] = {"from": spec.published, "path": target}
        if not dry_run:
            pull(spark, spec.published, target, digests)
            report = artifact.validate_artifact(spark, target, spec.width, spec.layers, f"{target}/validation-local.json", spec.dtype, digests)
            row |= {"records": report["records"], "valid": report["valid"], "problems": report["problems"]}
        out.append(row)
    bad = [r for r in out if r.get("valid") is False]
    if bad:
        raise ValueError("; ".join(f"{r['path']}: {r['problems']}" for r in bad))
    return out
