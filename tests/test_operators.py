from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import integrity, packing, records


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def normalized(spark, row, view="full", **more):
    df = spark.createDataFrame([(7, json.dumps(row))], "source_index long, value string")
    return records.normalize_records(df, view=view, **more).first()


def test_structured_record(spark):
    row = {"context": " c ", "question": "q?", "best_answer": "One. Two.", "label": 1}
    full, cut = normalized(spark, row), normalized(spark, row, "first_sentence")
    assert full.text.endswith(" Answer: One. Two.") and full.label == 1
    assert cut.answer == "One." and cut.original_answer == "One. Two." and cut.text.endswith(" Answer: One.")


def test_prejoined_record_is_unchanged_by_view(spark):
    row = {"text": "  all. of it ", "best_answer": "One. Two.", "label": None}
    for view in records.VIEWS:
        r = normalized(spark, row, view)
        assert (r.text, r.answer, r.label) == ("  all. of it ", "One. Two.", None)


@pytest.mark.parametrize(
    ("row", "answer"),
    [
        ({"best_answer": {"input_text": ["x", "y"]}}, "x"),
        ({"best_answer": {"text": "t"}}, "t"),
        ({"answers": ["a"]}, "a"),
        ({"answer": 5}, "5"),
        ({"best_answer": None, "answer": "later"}, "None"),
        ({"best_answer": True}, "True"),
        ({"best_answer": "b", "answer": "later"}, "b"),
    ],
)
def test_answer_chain(spark, row, answer):
    assert normalized(spark, {"question": "q", **row}).original_answer == answer


@pytest.mark.parametrize(("label", "expected"), [(1, 1), ("1", 1), (True, 1), (1.7, 1), (None, None)])
def test_labels(spark, label, expected):
    assert normalized(spark, {"text": "t", "label": label}).label == expected


def test_bad_records(spark):
    with pytest.raises(Exception, match="label is no integer"):
        normalized(spark, {"text": "t", "label": "1.7"})
    with pytest.raises(Exception, match="row 7 needs"):
        normalized(spark, {"question": " ", "best_answer": "a"})
    r = normalized(spark, {"question": "q", "best_answer": []}, strict=False)
    assert r.rejected and r.text is None
    with pytest.raises(ValueError):
        normalized(spark, {"text": "t"}, "other")


def test_context_falls_back_to_story(spark):
    assert normalized(spark, {"question": "q", "best_answer": "a", "story": "s"}).context == "s"
    assert normalized(spark, {"question": "q", "best_answer": "a", "context": None, "story": "s"}).context == "None"


def test_strided_partition_is_complete_and_disjoint(spark):
    got = packing.with_ordinal(spark.range(101).withColumnRenamed("id", "k"), "k").withColumn("rank", packing.rank_of(F.col("ordinal"), 8))
    assert rows_of(got, "k", "ordinal", "rank") == [(i, i, i % 8) for i in range(101)]
    with pytest.raises(ValueError):
        packing.rank_of(F.col("ordinal"), 8, 8)


def test_ordinal_of_sparse_keys_and_groups(spark):
    keys = sorted(random.Random(1).sample(range(-(10**12), 10**12), 500))
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long")
    assert rows_of(packing.with_ordinal(df, "k"), "ordinal", "k") == list(enumerate(keys))
    for g in range(3):
        own = [k for k in keys if k % 3 == g]
        assert rows_of(packing.with_ordinal(df, "k", ["g"]).where(F.col("g") == g), "ordinal", "k") == list(enumerate(own))
    assert packing.with_ordinal(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(("batch", "shard"), [(1, 64), (8, 64), (8, 20), (3, 7), (10, 4), (64, 64)])
def test_greedy_shards(spark, batch, shard):
    rng = random.Random(batch * 100 + shard)
    rows = [(i, rng.choice([128, 256, 512, 2048]), i % 2) for i in range(211)]
    got = {r.source_index: (r.shard, r.offset) for r in packing.with_shards(spark.createDataFrame(rows, "source_index long, bucket int, rank int"), batch, shard, by=["rank"], first=3).collect()}
    for rank in range(2):
        number, held, n = 3, 0, 0
        for b in (128, 256, 512, 2048):
            own = [i for i, x, r in rows if x == b and r == rank]
            for at in range(0, len(own), batch):
                lot = own[at : at + batch]
                for k, i in enumerate(lot):
                    assert got[i] == (number, held + k)
                held, n = held + len(lot), n + len(lot)
                if held >= shard:
                    number, held = number + 1, 0
        assert n == sum(r == rank for _, _, r in rows)


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(i, 128 if i < 10 else 256) for i in range(15)], "source_index long, bucket int")
    got = packing.with_batches(df, 4)
    assert rows_of(got.groupBy("bucket", "batch_id").agg(F.count("*").alias("n"), F.max("batch_pad").alias("p")), "bucket", "batch_id", "n", "p") == [(128, 0, 4, 0), (128, 1, 4, 0), (128, 2, 2, 2), (256, 0, 4, 0), (256, 1, 1, 3)]


def test_shard_names(spark):
    r = spark.range(1).select(packing.shard_name(F.lit(12), F.lit(3)), packing.shard_number(F.lit("x/shard-00012.parquet")), packing.shard_number(F.lit("other"))).first()
    assert tuple(r) == ("rank-003/shard-00012", 12, None)
    assert packing.next_shard(spark.createDataFrame([], "shard long")).first()[0] == 0


PART = dict(source_index=0, paper_split="train", context="c", question="q", best_answer=" a ", label=0, answer_view="full", text="Summarize the following document in one or two concise sentences.\nDocument:c\nSummary: a")
SCHEMA = "source_index long, paper_split string, context string, question string, best_answer string, label int, answer_view string, text string"


@pytest.mark.parametrize(
    ("change", "problem"),
    [({}, None), ({"question": ""}, "missing question"), ({"context": None, "label": None}, "missing context,label"), ({"paper_split": "dev"}, "invalid paper_split"), ({"label": 2}, "invalid label"), ({"answer_view": "fst"}, "answer_view mismatch")],
)
def test_row_problems(spark, change, problem):
    df = spark.createDataFrame([tuple((PART | change).values())], SCHEMA)
    found = [r.problem for r in integrity.row_problems(df, splits=("train", "test"), view="full").collect()]
    assert found == ([problem] if problem else [])


def test_other_part_rules(spark):
    df = spark.createDataFrame([tuple((PART | c).values()) for c in ({}, {"source_index": 2}, {"source_index": 2, "text": "x"}, {"source_index": 9})], SCHEMA)
    assert rows_of(integrity.prompt_mismatches(df), "source_index") == [(2,)]
    assert rows_of(integrity.duplicates(df), "source_index", "n") == [(2, 2)]
    assert rows_of(integrity.coverage_gaps(df, 0, 4), "source_index", "problem") == [(1, "missing"), (3, "missing"), (9, "unexpected")]
    other = df.where("source_index <> 9").withColumn("context", F.when(F.col("source_index") == 0, F.lit(None)).otherwise(F.col("context"))).dropDuplicates(["source_index"])
    assert rows_of(integrity.cross_view_mismatches(df.dropDuplicates(["source_index"]), other, ["context", "paper_split"]), "source_index", "column") == [(0, "context"), (9, "missing")]


def test_counts_and_histograms(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "s string, label int")
    assert rows_of(integrity.count_mismatches(df, {("a",): 2, ("b",): 2, ("c",): 1}, ["s"]), "s", "expected", "observed") == [("b", 2, 1), ("c", 1, 0)]
    assert rows_of(integrity.label_histogram(df, ["s"]), "s", "label", "n", "both_classes") == [("a", 0, 1, True), ("a", 1, 1, True), ("b", 1, 1, False)]
    assert integrity.histogram_map(df, "label").first()[0] == {0: 1, 1: 2}


def test_metadata_problems_fire_once_each(spark):
    meta = [(i, i % 2, i % 2, i // 2) for i in range(6)]
    schema = "source_index long, rank int, shard long, offset long"
    tensors = spark.createDataFrame([(0, 3), (1, 3)], "shard long, rows long")

    def rules(rows, writers=2, records=6, held=6, t=tensors):
        return sorted(r.rule for r in integrity.metadata_problems(spark.createDataFrame(rows, schema), t, writers, records, held).collect())

    assert rules(meta) == []
    assert rules(meta, writers=3) == ["missing_metadata"]
    assert rules([*meta[:-1], (5, 4, 1, 2)]) == ["foreign_rank"]
    assert rules([*meta[:-1], (5, 1, 9, 0)]) == ["missing_shard", "offsets"]
    assert rules([*meta[:-1], (5, 1, 1, 0)]) == ["offsets"]
    assert rules([*meta[:-1], (4, 1, 1, 2)]) == ["duplicate_index"]
    assert rules(meta, records=7) == ["metadata_rows", "tensor_rows"]
    assert rules(meta, held=7) == ["manifest_tensor_rows"]


def test_resume_covers_the_rest(spark):
    whole, done = spark.range(20).withColumnRenamed("id", "source_index"), spark.createDataFrame([(3,), (3,), (5,)], "source_index long")
    assert rows_of(integrity.remaining(whole, done), "source_index") == [(i,) for i in range(20) if i not in (3, 5)]
    assert integrity.same_rows(whole, integrity.union_parts([whole.where("source_index < 7"), whole.where("source_index >= 7")])).count() == 0


def test_ranges_stay_even_beside_a_far_key(spark):
    from granary.operators import ordinals, packing

    rows = spark.range(40_000).select("id").unionByName(spark.createDataFrame([(2**62,), (-(2**62),)], "id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one range
    try:
        laid = ordinals.lay_out(rows, "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in ordinals.spans(laid).select(F.col("_n").alias("n")).collect()]
    assert sum(sizes) == 40_002 and max(sizes) < 3 * sum(sizes) / len(sizes) and len(sizes) > 2
    got = packing.with_ordinal(rows, "id").orderBy("id").collect()
    assert [r.ordinal for r in got] == list(range(40_002)) and got[0].id == -(2**62)


def test_ordinals_of_null_groups(spark):
    from granary.operators import packing

    df = spark.createDataFrame([(3, None), (1, None), (2, "a"), (5, "a"), (4, "b")], "k long, g string")
    assert sorted((r.k, r.ordinal) for r in packing.with_ordinal(df, "k", ["g"]).collect()) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1)]
    with pytest.raises(Exception, match="k is null"):
        packing.with_ordinal(df.withColumn("k", F.when(F.col("k") > 1, F.col("k"))), "k").collect()


def test_constraints_scan_the_metadata_once(spark, monkeypatch):
    from granary.operators import integrity

    meta = spark.createDataFrame([(0, 0, "a", 0), (1, 0, "a", 0), (2, 1, "b", 0), (2, 5, "c", 0), (3, None, "b", 2)], "source_index long, rank int, shard string, offset long")
    held = spark.createDataFrame([("a", 2), ("b", 2)], "shard string, rows long")
    plans = []
    own = integrity.stage_boundary
    monkeypatch.setattr(integrity, "stage_boundary", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    got = {(r.rule, r.subject, r.detail) for r in integrity.metadata_problems(meta, held, 3, 5, 4).collect()}
    assert got == {
        ("foreign_rank", "5", "1"), ("foreign_rank", None, "1"), ("missing_shard", "c", "metadata refers to it"), ("offsets", "a", "incomplete or duplicate"), ("offsets", "b", "incomplete or duplicate"),
        ("duplicate_index", "2", "2"), ("tensor_rows", "5", "4"), ("missing_metadata", "2", "no rows of this rank"),
    }
    assert len(plans) == 1 and plans[0].count("LogicalRDD") + plans[0].count("LocalRelation") == 2
    assert integrity.problem_summary(integrity.metadata_problems(meta, held, 3, 5, 4))[-1].endswith("tensor_rows 5: 4")
