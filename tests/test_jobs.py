from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from granary.operators import inference
from granary.plans import config, jobs
from granary.sources import artifact, digests, jsonl, publish


def write_lines(path, lines, end="\n"):
    path.write_bytes(end.join(lines).encode() + end.encode())
    return str(path)


def test_line_numbers_count_blank_lines(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", ['{"text": "a"}', "", "  ", '{"text": "b"}', '{"text": "c"}'], "\r\n")
    assert [(r.source_index, json.loads(r.value)["text"]) for r in jsonl.load_rows(spark, path).orderBy("source_index").collect()] == [(0, "a"), (3, "b"), (4, "c")]
    assert [r.source_index for r in jsonl.load_rows(spark, path, 1, 3).collect()] == [3]
    with pytest.raises(ValueError, match="no records"):
        jsonl.load_rows(spark, path, 1, 2)


def test_line_numbers_over_splits(spark, tmp_path):
    path = write_lines(tmp_path / "b.jsonl", [f"line {i} " + "x" * (i % 50) for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = jsonl.read_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line, int(r.value.split()[1])) for r in rows) == [(i, i) for i in range(3000)]


def test_positional_sample(spark, tmp_path):
    path = write_lines(tmp_path / "c.jsonl", [str(i) for i in range(100)])
    assert sorted(int(r.value) for r in jsonl.positional_sample(jsonl.read_lines(spark, path)).collect()) == list(jsonl.SAMPLE_POSITIONS)
    with pytest.raises(ValueError, match="expected 8"):
        jsonl.positional_sample(jsonl.read_lines(spark, write_lines(tmp_path / "d.jsonl", ["1"] * 20)))


def test_documents_and_digests(spark, tmp_path):
    place = str(tmp_path / "x.json")
    jsonl.write_document(spark, place, {"b": 1, "a": "é"})
    assert jsonl.read_document(spark, place) == {"a": "é", "b": 1}
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')
    assert jsonl.json_digest({"b": 1, "a": 2}) == jsonl.json_digest({"a": 2, "b": 1})
    import hashlib

    r = digests.file_digests(spark, str(tmp_path), "*.json").first()
    assert r.sha256 == hashlib.sha256((tmp_path / "x.json").read_bytes()).hexdigest()
    with pytest.raises(FileNotFoundError):
        jsonl.read_document(spark, str(tmp_path / "none.json"))


@pytest.fixture
def run(tmp_path):
    path = write_lines(tmp_path / "in.jsonl", [json.dumps({"text": "w " * (1 + i % 300)}) for i in range(60)])
    return config.RunConfig(input=path, output=str(tmp_path / "out"), width=4, batch_size=2, shard_size=8, world_size=2, mode="replicated")


def test_extract_validate_resume(spark, run):
    first = replace(run, max_samples=30)
    assert jobs.extract(spark, first)["records"] == 30
    assert jobs.validate(spark, first)["valid"]
    assert config.completed_and_valid(spark, run.output, 30) and not config.completed_and_valid(spark, run.output, 31)
    with pytest.raises(ValueError, match="other options"):
        jobs.extract(spark, run)
    with pytest.raises(FileExistsError):
        jobs.extract(spark, first)
    assert jobs.extract(spark, replace(first, resume=True))["records"] == 30
    assert jobs.extract(spark, replace(run, overwrite=True))["records"] == 60
    report = jobs.validate(spark, run)
    assert report["valid"] and report["records_per_rank"] == {0: 30, 1: 30}


def begin(spark, run, where):
    """What a run leaves that was stopped when the rows of a condition were written."""
    config.guard_output(spark, run)
    part = jobs.plan_extraction(jsonl.load_rows(spark, run.input), run).where(where)
    artifact.write_shards(inference.infer(artifact.lay_out_shards(part, 60, 100), inference.stub_layers(4), 4, batch=run.effective_batch), run.output)


def test_resume_processes_the_same_keys(spark, run):
    begin(spark, run, "source_index < 21")
    manifest = jobs.extract(spark, replace(run, resume=True))
    got = artifact.read_shards(spark, run.output)
    assert sorted(r[0] for r in got.select("source_index").collect()) == list(range(60))
    reports = manifest["rank_reports"]
    assert [(r["assigned_records"], r["previously_completed"], r["processed_this_run"]) for r in reports] == [(30, 11, 19), (30, 10, 20)]
    assert sum(r["processed_this_run"] + r["previously_completed"] for r in reports) == manifest["records"] == 60 and all(r["elapsed_seconds"] > 0 for r in reports)
    assert jobs.validate(spark, run)["valid"]


def test_a_changed_input_is_another_run(spark, run, tmp_path):
    first = replace(run, max_samples=None)
    assert jobs.extract(spark, first)["records"] == 60
    text = (tmp_path / "in.jsonl").read_text()
    write_lines(tmp_path / "in.jsonl", [json.dumps({"text": f"other {i}"}) for i in range(90)])
    with pytest.raises(ValueError, match="input_content"):
        jobs.extract(spark, replace(first, resume=True))
    (tmp_path / "in.jsonl").write_text(text)  # the same content again, in a new file
    assert jobs.extract(spark, replace(first, resume=True))["records"] == 60


def test_a_content_digest_does_not_depend_on_cuts(spark, tmp_path):
    path = write_lines(tmp_path / "e.jsonl", [f"line {i} " + "y" * (i % 70) for i in range(2000)])
    whole = digests.content_digest(jsonl.read_lines(spark, path)).first()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        cut = digests.content_digest(jsonl.read_lines(spark, path)).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    swapped = digests.content_digest(jsonl.read_lines(spark, write_lines(tmp_path / "f.jsonl", [f"line {i ^ 1} " + "y" * ((i ^ 1) % 70) for i in range(2000)]))).first()
    assert whole == cut and whole.lines == swapped.lines == 2000 and whole.digest != swapped.digest
    assert digests.content_digest(spark.createDataFrame([], "line long, value string")).first().lines == 0


@pytest.mark.parametrize("dtype", ["float32", "bfloat16"])
def test_layer_states_go_through_the_job(spark, run, dtype):
    import numpy as np

    from granary.functions import tensors

    own = replace(run, layers=3, dtype=dtype, buckets=(128, 256))
    manifest = jobs.extract(spark, own)
    report = jobs.validate(spark, own)
    assert report["valid"] and report["records"] == 60 and manifest["hidden_states_shape"] == [3, 4]
    rows = jobs.plan_extraction(jsonl.load_rows(spark, run.input), own).select("source_index", "token_ids").collect()
    ids = {r.source_index: r.token_ids for r in rows}
    df = artifact.read_shards(spark, own.output)
    if dtype == "bfloat16":
        df = df.withColumn("embedding", tensors.unpack_bfloat16("embedding"))
        df = df.withColumn("hidden_states", F.array(*[tensors.unpack_bfloat16(F.col("hidden_states")[k]) for k in range(3)]))
    for r in df.collect():
        e = lambda t: np.array([((31 * t + 17 * j) % 97 - 48) / 64 for j in range(4)])
        last = ids[r.source_index][-min(len(ids[r.source_index]), r.bucket) :]
        want = [sum(e(t) for t in last[-1 - k :]) for k in range(3)]
        assert np.array_equal(r.embedding, e(last[-1])) and np.array_equal(np.array(r.hidden_states), want)


@pytest.mark.parametrize(
    ("produce", "message"),
    [
        (lambda t, m: [(k, x) for k, x in inference.stub_layers(4, 3)(t, m) if k != 1], "were given, not"),
        (lambda t, m: inference.stub_layers(4, 4)(t, m), "were given, not"),
        (lambda t, m: [*inference.stub_layers(4, 3)(t, m), (1, inference.np.zeros((*t.shape, 4)))], "given twice"),
        (lambda t, m: inference.stub_layers(5, 3)(t, m), "has the shape"),
        (lambda t, m: [(k, x * (float("inf") if k == 2 else 1)) for k, x in inference.stub_layers(4, 3)(t, m)], "aren't finite in layers 2"),
    ],
)
def test_wrong_layers_stop_before_the_write(spark, run, tmp_path, produce, message):
    with pytest.raises(Exception, match=message):
        jobs.extract(spark, replace(run, layers=3), produce)
    assert not (tmp_path / "out" / "manifest.json").exists() and not list((tmp_path / "out" / "states").glob("*.parquet"))


def test_a_norm_changes_the_last_layer_alone(spark, run):
    import numpy as np

    weight = (1.0, 2.0, 0.5, 1.0)
    plain, normed = replace(run, layers=2, output=run.output + "a"), replace(run, layers=2, output=run.output + "b", norm=weight)
    for c in (plain, normed):
        jobs.extract(spark, c)
    rows = lambda c: {r.source_index: np.array(r.hidden_states) for r in artifact.read_shards(spark, c.output).collect()}
    a, b = rows(plain), rows(normed)
    for i, x in a.items():
        assert np.array_equal(x[0], b[i][0]) and np.allclose(b[i][1], x[1] / np.sqrt(np.mean(x[1] ** 2) + 1e-5) * weight, rtol=1e-5)


def test_batches_are_of_one_bucket_and_padded_to_their_size(spark, run):
    seen = spark.sparkContext.accumulator(0)

    def produce(tokens, mask):
        assert tokens.shape[0] == 2 and tokens.shape[1] in (128, 256) and mask[:, -1].all()
        seen.add(len(tokens))
        return inference.stub_layers(4)(tokens, mask)

    own = replace(run, buckets=(128, 256))
    jobs.extract(spark, own, produce)
    batches = jobs.plan_extraction(jsonl.load_rows(spark, run.input), own).select("rank", "bucket", "batch_id").distinct().count()
    assert seen.value == 2 * batches


def copy_states(spark, run, to, change=None):
    df = artifact.read_shards(spark, run.output)
    (change(df) if change else df).coalesce(1).write.mode("overwrite").parquet(f"{to}/states")
    for name in ("index", "files"):
        spark.read.parquet(f"{run.output}/{name}").write.mode("overwrite").parquet(f"{to}/{name}")
    jsonl.write_document(spark, f"{to}/manifest.json", jsonl.read_document(spark, f"{run.output}/manifest.json"))


def rules(report):
    return sorted(p.split()[0] for p in report["problems"])


def test_validation_gathers_problems(spark, run):
    jobs.extract(spark, run)
    to = run.output + "2"
    copy_states(spark, run, to, lambda df: df.withColumn("embedding", F.when(F.col("source_index") == 3, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))))
    extra = spark.createDataFrame([(0, 99, "states/rank-000/shard-00099", "x.parquet", 0, 1)], spark.read.parquet(f"{run.output}/index").schema)
    extra.write.mode("append").parquet(f"{to}/index")
    manifest = jsonl.read_document(spark, f"{to}/manifest.json")
    jsonl.write_document(spark, f"{to}/manifest.json", manifest | {"tensor_rows": 61})
    report = artifact.validate_artifact(spark, to, 4)
    assert not report["valid"] and report["records"] == 60
    assert rules(report) == ["damaged_file", "embedding_finite", "embedding_shape", "manifest_tensor_rows", "missing_rows"]


def test_lost_and_foreign_rows_are_found(spark, run):
    jobs.extract(spark, run)
    to = run.output + "3"
    copy_states(spark, run, to, lambda df: df.where("NOT (rank = 0 AND shard = 1) AND source_index <> 0").unionByName(df.limit(1).withColumn("shard", F.lit(77).cast("long")).withColumn("source_index", F.lit(500).cast("long"))))
    report = artifact.validate_artifact(spark, to, 4)
    assert rules(report) == ["damaged_file", "index_rows", "manifest_tensor_rows", "metadata_rows", "missing_rows", "missing_shard", "offsets", "tensor_rows"]


def test_a_file_with_other_columns_is_left_out_of_the_totals(spark, run, tmp_path):
    own = replace(run, layers=2, output=run.output + "4")
    jobs.extract(spark, own)
    whole = jobs.validate(spark, own)["records"]
    df = artifact.read_shards(spark, own.output)
    df.limit(3).drop("hidden_states").coalesce(1).write.mode("append").parquet(f"{own.output}/states")
    df.limit(2).withColumn("embedding", F.lit("x")).coalesce(1).write.mode("append").parquet(f"{own.output}/states")
    (tmp_path / "out4" / "states" / "part-broken.parquet").write_bytes(b"PAR1 not a file")
    report = jobs.validate(spark, own)
    assert report["records"] == whole == 60 and rules(report) == ["damaged_file", "vector_columns"]
    assert "the first of 3" in report["problems"][1]


def test_a_changed_byte_is_found(spark, run, tmp_path):
    jobs.extract(spark, run)
    files = spark.read.parquet(f"{run.output}/files").collect()
    assert all(f.bytes > 0 and len(f.sha256) == 64 for f in files) and sum(f.rows for f in files) == 60
    file = sorted((tmp_path / "out" / "states").glob("*.parquet"))[0]
    data = bytearray(file.read_bytes())
    at = data.rindex(b"parquet-mr")  # a letter of the footer, so the file can still be read
    data[at] ^= 0x20
    file.write_bytes(bytes(data))
    for x in file.parent.glob(".*.crc"):
        x.unlink()
    spark.catalog.clearCache()
    assert jobs.validate(spark, run)["problems"] == [f"damaged_file {file.name}: other digest"]
    assert jobs.validate(spark, run, digests=False)["valid"]


def test_the_index_tells_where_a_shard_is(spark, run):
    manifest = jobs.extract(spark, replace(run, layers=2))
    index = spark.read.parquet(f"{run.output}/index").collect()
    assert manifest["num_shards"] == len({(r.rank, r.shard) for r in index}) and sum(r.rows for r in index) == 60 and "path" not in json.dumps(manifest["rank_reports"])
    r = next(r for r in index if r.shard == 1)
    own = spark.read.parquet(f"{run.output}/states/{r.file}").select("rank", "shard", "offset", F.col("_metadata.row_index").alias("i")).where(F.col("i").between(r.first_row, r.first_row + r.rows - 1)).orderBy("i").collect()
    assert [(x.rank, x.shard, x.offset) for x in own] == [(r.rank, 1, k) for k in range(r.rows)]


def test_many_shards_need_no_list(spark, tmp_path):
    """As many shards as rows: what the manifest holds and what comes to the driver doesn't grow."""
    n, out = 100_000, str(tmp_path / "many")
    rows = spark.range(n).select(F.col("id").alias("source_index"), F.lit("x").alias("input_sha256"), F.lit(1).cast("long").alias("token_count"), F.lit(128).alias("bucket"), F.lit(0).alias("truncated_tokens"), F.lit(0).alias("label"), F.lit(0).alias("rank"), F.col("id").alias("shard"), F.lit(0).cast("long").alias("offset"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    artifact.write_shards(artifact.lay_out_shards(rows, n, 200, 1 << 20), out)
    artifact.write_index(spark, out)
    manifest = artifact.build_manifest(spark, out, {}, 1)
    jsonl.write_document(spark, f"{out}/manifest.json", manifest)
    assert manifest["num_shards"] == n and manifest["num_files"] < 40 and len(json.dumps(manifest)) < 1000
    report = artifact.validate_artifact(spark, out, 1)
    assert report["valid"] and report["shards"] == n


def test_a_long_file_is_digested_in_chunks(spark, tmp_path):
    import hashlib

    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate((2 << 30) + 12_345)
    want, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(128):
        want.update(block)
    want.update(bytes(12_345))
    r = digests.file_digests(spark, str(tmp_path / "sparse.bin")).first()
    assert (r.bytes, r.sha256) == ((2 << 30) + 12_345, want.hexdigest())


def test_publishing_is_resumed_and_the_receipt_is_last(spark, run, tmp_path, monkeypatch):
    own = replace(run, push_to="me/box", store=str(tmp_path / "store"))
    jobs.extract(spark, own)
    jobs.validate(spark, own)
    assert own.published == f"{tmp_path}/store/me/box/out"

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(publish, "write_document", killed)
        with pytest.raises(KeyboardInterrupt):
            publish.publish(spark, own.output, own.published)
    assert not publish.is_published(spark, own.published) and (tmp_path / "store" / "me" / "box" / "out" / "manifest.json").exists()
    with pytest.raises(FileNotFoundError, match="receipt"):
        publish.pull(spark, own.published, str(tmp_path / "pulled"))
    receipt = publish.publish(spark, own.output, own.published)
    assert receipt["copied"] == 0 and receipt["kept"] == receipt["files"] > 4 and publish.is_published(spark, own.published)
    assert publish.publish(spark, own.output, own.published)["digest"] == receipt["digest"]
    [row] = jobs.pull_specs(spark, [own, run], str(tmp_path / "pulled"))
    assert row["valid"] and row["records"] == 60
    victim = next((tmp_path / "store" / "me" / "box" / "out" / "states").glob("*.parquet"))
    victim.write_bytes(victim.read_bytes()[:-9] + b"changed!!")
    with pytest.raises(OSError, match="receipt"):
        publish.pull(spark, own.published, str(tmp_path / "again"))


def test_the_preflight_gates_full_runs(spark, run, tmp_path):
    write_lines(tmp_path / "in.jsonl", [json.dumps({"text": f"{i} w"}) for i in range(100)])
    gate = jobs.Preflight(str(tmp_path / "gate"))

    def broken(tokens, mask):
        for k, x in inference.stub_layers(4)(tokens, mask):
            yield k, x * float("nan")

    with pytest.raises(Exception, match="finite"):
        jobs.run_specs(spark, [run], [100], broken, preflight=gate)
    assert not (tmp_path / "out").exists()
    assert jobs.run_specs(spark, [run], [100], preflight=gate, dry_run=True) == [(gate.output, "would run"), (run.output, "would run")]
    assert jobs.run_specs(spark, [run], [100], preflight=gate, preflight_only=True) == [(gate.output, "valid")]
    assert jobs.run_specs(spark, [run], [100], preflight=gate) == [(gate.output, "valid before"), (run.output, "ran")]
    sample = artifact.read_shards(spark, f"{gate.output}/run")
    assert sample.count() == 8 and {r[0] for r in sample.select("bucket").distinct().collect()} == {1024}


def test_the_number_of_slots_is_asserted(spark, run):
    slots = spark.sparkContext.defaultParallelism
    jobs.check_slots(spark, replace(run, expected_slots=slots))
    jobs.check_slots(spark, run)
    with pytest.raises(RuntimeError, match=f"expected {slots + 1} task slots, found {slots}"):
        jobs.extract(spark, replace(run, expected_slots=slots + 1))


def test_a_vocabulary_gives_the_ids(spark, run, tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"w ": 300, b" w": 256}
    lines = [f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()]
    own = replace(run, vocabulary=write_lines(tmp_path / "v.txt", lines))
    got = {r.source_index: r.token_ids for r in jobs.plan_extraction(jsonl.load_rows(spark, own.input), own).collect()}
    assert got[0] == [ord("w"), ord(" ")] and got[2] == [ord("w"), 256, 256, ord(" ")]
    assert jobs.extract(spark, own)["records"] == 60 and jobs.validate(spark, own)["valid"]


def test_shards_go_on_behind_each_ranks_own(spark, run):
    rows = jsonl.load_rows(spark, run.input)
    done = spark.createDataFrame([(0, 0, 4), (1, 1, 0)], "source_index long, rank int, shard int")
    first = {r[0]: r[1] for r in jobs.plan_extraction(rows, run, done).groupBy("rank").agg(F.min("shard")).collect()}
    assert first == {0: 5, 1: 1}


def test_run_specs(spark, run):
    assert jobs.run_specs(spark, [run], [60], dry_run=True) == [(run.output, "would run")]
    assert jobs.run_specs(spark, [run], [60]) == [(run.output, "ran")]
    assert jobs.run_specs(spark, [run], [60]) == [(run.output, "skipped")]
    assert jobs.run_specs(spark, [run], [60], only=["other"]) == []


@pytest.mark.parametrize("change", [{"batch_size": 0}, {"mode": "x"}, {"view": "x"}, {"mode": "spmd_fsdp", "debug_single_process": True}, {"mode": "spmd_fsdp", "parallel_load": True}, {"push_to": "a"}, {"push_to": "a/b"}, {"buckets": (0,)}])
def test_option_checks(run, change):
    with pytest.raises(ValueError):
        replace(run, **change).checked()


def test_broad_outputs_are_refused(spark, run, tmp_path):
    for place in ("/", str(__import__("pathlib").Path.home()), "file:///", "file:/", ".", "granary/..", "~", ""):
        with pytest.raises(ValueError, match="broad"):
            config.guard_output(spark, replace(run, output=place))
    with pytest.raises(FileNotFoundError):
        replace(run, input=str(tmp_path / "none")).checked(spark)


def part(tmp_path, name, start, end, change=None):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "SUCCESS").write_text("ok\n")
    (folder / "summary.json").write_text(json.dumps({"status": "complete", "source_range": [start, end]}))
    for v in ("full", "fst"):
        rows = []
        for i in range(start, end):
            row = {"source_index": i, "paper_split": "test" if i % 5 == 0 else "train", "context": "c", "question": "q", "best_answer": "a", "label": (i // 5) % 2 if i % 5 == 0 else i % 2, "answer_view": v}
            row["text"] = "Summarize the following document in one or two concise sentences.\nDocument:c\nSummary: a"
            rows.append(row | (change or {}).get((v, i), {}))
        write_lines(folder / f"{v}.jsonl", [json.dumps(r) for r in rows])
    return jobs.PartSpec(name, str(folder), start, end)


def test_prepare_parts(spark, tmp_path):
    parts = [part(tmp_path, "p0", 0, 10), part(tmp_path, "p1", 10, 20)]
    out = str(tmp_path / "prepared")
    assert jobs.prepare_parts(spark, parts, out, {"train": 16, "test": 4})["rows"] == 40
    assert spark.read.json(f"{out}/fst_test.jsonl").count() == 4
    with pytest.raises(FileExistsError):
        jobs.prepare_parts(spark, parts, out, {"train": 16, "test": 4})
    assert jobs.prepare_parts(spark, parts, out, {"train": 16, "test": 4}, reuse=True)["rows"] == 40
    with pytest.raises(FileExistsError, match="expected"):
        jobs.prepare_parts(spark, parts, out, {"train": 15, "test": 5}, reuse=True)
    file = next((tmp_path / "prepared" / "fst_test.jsonl").glob("part-*"))
    file.write_text(file.read_text().replace("test", "tess"))
    with pytest.raises(FileExistsError, match="fst_test"):
        jobs.prepare_parts(spark, parts, out, {"train": 16, "test": 4}, reuse=True)
    with pytest.raises(ValueError, match="split counts"):
        jobs.prepare_parts(spark, parts, out, {"train": 15, "test": 4}, overwrite=True)


@pytest.mark.parametrize("keep", [True, False])
def test_parts_are_staged(spark, tmp_path, keep):
    parts = [part(tmp_path, "p0", 0, 10), part(tmp_path, "p1", 10, 20)]
    assert jobs.prepare_parts(spark, parts, str(tmp_path / "prepared"), {"train": 16, "test": 4}, staging=str(tmp_path / "stage"), keep_staging=keep)["rows"] == 40
    assert (tmp_path / "stage" / "p1" / "full.jsonl").exists() == keep and (tmp_path / "p1" / "full.jsonl").exists()


def test_part_problems(spark, tmp_path):
    p = part(tmp_path, "bad", 0, 10, {("full", 3): {"context": "other"}, ("fst", 4): {"label": 3}, ("fst", 5): {"source_index": 6}})
    _, problems = jobs.part_problems(spark, p, ["train", "test"])
    text = "\n".join(problems)
    for word in ("text is not the prompt", "invalid label", "source_index is there several times", "missing", "context differs"):
        assert word in text
    (tmp_path / "bad" / "SUCCESS").write_text("no")
    assert jobs.part_problems(spark, p, ["train", "test"])[1][0] == "bad: marker: found 'no', wanted 'ok'"
    (tmp_path / "bad" / "summary.json").unlink()
    assert jsonl.completion_problems(spark, p.folder, 0, 10)[1:] == ["status: found None, wanted 'complete'", "source_range: found None, wanted [0, 10]"]


def test_qa_problems(spark, tmp_path):
    df = spark.createDataFrame([("c", "q", "a", 0, "train"), ("c", "", "a", 1, "dev")], jobs.QA_SCHEMA)
    assert jobs.qa_problems(df, "train", 3) == ["missing question: 1 rows", "source_split differs in 1 rows", "2 rows, not 3"]
    path, own = write_lines(tmp_path / "q.jsonl", ["{}"]), __import__("hashlib").sha256(b"{}\n").hexdigest()
    assert jobs.qa_problems(df, "train", 3, "y", path)[-1] == f"digest is {own}, not y" and len(jobs.qa_problems(df, "train", 3, own, path)) == 3
    assert jobs.qa_problems(df.limit(1).unionByName(df.limit(1).withColumn("label", F.lit(1))), "train", 2) == []


def test_artifacts_of_documents_without_words(spark, tmp_path):
    from granary.plans import registry

    rows = [(i, f"word {i} " * 40) for i in range(200)]
    for i, text in ((0, None), (3, ""), (70, " \n\t "), (199, "\r\n")):  # no words: no record, but a number
        rows[i] = (i, text)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    own = {name: registry.QUERIES[name](spark, str(tmp_path)).collect() for name in ("artifact_roundtrip", "artifact_problems", "layer_states")}
    assert [tuple(r) for r in own["artifact_roundtrip"]] == [(196, 4, 196, True)]
    assert {(r.artifact, r.records, r.shards, r.valid) for r in own["artifact_problems"]} == {("whole", 196, 4, True), ("damaged", 132, 3, False)}
    assert sorted(r.source_index for r in own["layer_states"]) == [i for i in range(200) if i not in (0, 3, 70, 199)]
