"""Joins, set operations and constraints.  Each constraint is a query that returns its violations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, summary_prompt
from ..sources.tables import stage_boundary

# Fields that a prepared part's row must have.
PART_FIELDS = ("source_index", "paper_split", "context", "question", "best_answer", "label", "answer_view", "text")


def remaining(records: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """Records whose key isn't done yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_fields(fields: Sequence[str]) -> Column:
    """Sorted names of the fields that are null or ""; 0 is present."""
    names = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in sorted(fields)]
    return F.array_compact(F.array(*names))


def row_problems(df: DataFrame, fields: Sequence[str] = PART_FIELDS, key: str = "source_index", splits: Sequence[str] | None = None, view: str | None = None) -> DataFrame:
    """(key, problem) of rows with missing fields, a split, label or view outside its domain."""
    empty = missing_fields(fields)
    found = [F.when(F.size(empty) > 0, F.concat(F.lit("missing "), F.array_join(empty, ",")))]
    if splits is not None:
        found.append(F.when(~F.col("paper_split").isin(*splits), F.lit("invalid paper_split")))
    found.append(F.when(~F.col("label").isin(0, 1), F.lit("invalid label")))
    if view is not None:
        found.append(F.when(F.col("answer_view") != view, F.lit("answer_view mismatch")))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("problem"))


def prompt_mismatches(df: DataFrame, key: str = "source_index") -> DataFrame:
    """Rows whose text isn't the summary prompt of their context and their stripped answer."""
    expected = F.concat(summary_prompt(F.col("context")), F.lit(" "), strip(F.col("best_answer")))
    return df.where(~F.col("text").eqNullSafe(expected)).select(key)


def duplicates(df: DataFrame, key: str = "source_index") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(df: DataFrame, start: int, end: int, key: str = "source_index") -> DataFrame:
    """Keys of range(start, end) that are missing, and keys outside it."""
    wanted = df.sparkSession.range(start, end).select(F.col("id").alias(key), F.lit(1).alias("_w"))
    seen = df.select(F.col(key).cast("long").alias(key)).distinct().withColumn("_s", F.lit(1))
    return wanted.join(seen, key, "full_outer").where("_w IS NULL OR _s IS NULL").select(key, F.when(F.col("_w").isNull(), "unexpected").otherwise("missing").alias("problem"))


def cross_view_mismatches(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "source_index") -> DataFrame:
    """(key, column) where two views of one key differ, or one view lacks the key."""
    a = left.select(key, F.struct(*columns).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(key, F.struct(*columns).alias("_b"), F.lit(1).alias("_r"))
    j = a.join(b, key, "full_outer")
    lone = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.lit("missing"))
    differ = [F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in columns]
    return j.select(key, F.explode(F.array_compact(F.array(lone, *differ))).alias("column"))


def count_mismatches(df: DataFrame, expected: dict[tuple, int], by: Sequence[str]) -> DataFrame:
    """Groups whose number of rows isn't the expected one; absent groups count 0.  expected is small and broadcast."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    want = spark.createDataFrame([(*k, v) for k, v in expected.items()], ", ".join(f"{c} {kinds[c]}" for c in by) + ", expected long")
    have = df.groupBy(*by).agg(F.count("*").alias("observed"))
    return have.join(F.broadcast(want), list(by), "full_outer").select(*by, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed")).where("expected <> observed")


def label_histogram(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Rows by label, and whether both classes occur in the group."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    both = n.groupBy(*by).agg((F.array_sort(F.collect_set(label)) == F.array(F.lit(0), F.lit(1)).cast(f"array<{dict(df.dtypes)[label]}>")).alias("both_classes"))
    return n.join(both, list(by)) if by else n.crossJoin(F.broadcast(both))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shard_offsets(metadata: DataFrame, by: Sequence[str] = ("shard",)) -> DataFrame:
    """Per shard: rows, and whether its offsets are exactly 0 to rows - 1; counted, not collected."""
    stats = metadata.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("offset").alias("_d"), F.min("offset").alias("_a"), F.max("offset").alias("_z"))
    return stats.select(*by, "rows", ((F.col("_d") == F.col("rows")) & (F.col("_a") == 0) & (F.col("_z") == F.col("rows") - 1)).alias("contiguous"))


def manifest_rollup(metadata: DataFrame) -> DataFrame:
    """One row: records, shards, the next shard's number."""
    return metadata.agg(F.count("*").alias("records"), F.count_distinct("shard").alias("num_shards"), (F.coalesce(F.max("shard"), F.lit(-1)) + 1).cast("long").alias("next_shard"))


def histogram_map(df: DataFrame, column: str) -> DataFrame:
    """One row: a map from each value to its rows, in the order of values."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))


def metadata_stats(metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """(kind, key, n, places, low, high, held): what all rules need, from one scan of the metadata.

    Each row marks its rank, its place (shard, offset) and its source_index; equal marks are counted, then shards are summed over their places.
    Kinds: rank; index, those that are there several times; shard, with its rows, distinct offsets and their bounds, and the rows that tensors hold.
    Rows: one per shard, rank and repeated index; they are written once, and the rules read them.
    """
    mark = lambda kind, key, at: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), at.cast("long").alias("at"))
    marks = metadata.select(F.inline(F.array(mark("index", F.col("source_index"), F.lit(0)), mark("place", F.col("shard"), F.col("offset")), mark("rank", F.col("rank"), F.lit(0)))))
    held = tensors.select(F.lit("held").alias("kind"), F.col("shard").cast("string").alias("key"), F.col("rows").cast("long").alias("at"))
    counted = marks.unionByName(held).groupBy("kind", "key", "at").agg(F.count("*").alias("n")).where("kind <> 'index' OR n > 1")
    place = F.when(F.col("kind") == "place", F.col("at"))
    stats = counted.groupBy(F.when(F.col("kind").isin("place", "held"), "shard").otherwise(F.col("kind")).alias("kind"), "key").agg(
        F.sum(F.when(F.col("kind") != "held", F.col("n"))).alias("n"), F.count(place).alias("places"), F.min(place).alias("low"), F.max(place).alias("high"), F.max(F.when(F.col("kind") == "held", F.col("at"))).alias("held")
    )
    return stage_boundary(stats)


def metadata_problems(metadata: DataFrame, tensors: DataFrame, writers: int, records: int, tensor_rows: int) -> DataFrame:
    """All problems of an artifact's metadata against its tensor rows: (rule, subject, detail).

    metadata: source_index, rank, shard, offset.  tensors: shard, rows.  Problems accumulate; none stops the others.
    """
    stats = metadata_stats(metadata, tensors)
    problem = lambda rule, subject, detail: F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    rank, shard, own = F.col("kind") == "rank", F.col("kind") == "shard", F.col("n").isNotNull()
    whole = (F.col("places") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n") == F.col("held"))
    found = F.array(
        F.when(rank & ~F.coalesce(F.col("key").cast("long").between(0, writers - 1), F.lit(False)), problem("foreign_rank", F.col("key"), F.col("n"))),
        F.when(shard & own & F.col("held").isNull(), problem("missing_shard", F.col("key"), F.lit("metadata refers to it"))),
        F.when(shard & own & F.col("held").isNotNull() & ~F.coalesce(whole, F.lit(False)), problem("offsets", F.col("key"), F.lit("incomplete or duplicate"))),
        F.when(F.col("kind") == "index", problem("duplicate_index", F.col("key"), F.col("n"))),
    )
    each = stats.select(F.inline(F.array_compact(found)))
    totals = stats.agg(F.coalesce(F.sum(F.when(rank, F.col("n"))), F.lit(0)).alias("m"), F.coalesce(F.sum("held"), F.lit(0)).alias("t"))
    wrong = F.array(
        F.when(F.col("m") != records, problem("metadata_rows", F.lit(records), F.col("m"))),
        F.when(F.col("t") != records, problem("tensor_rows", F.lit(records), F.col("t"))),
        F.when(F.col("t") != tensor_rows, problem("manifest_tensor_rows", F.lit(tensor_rows), F.col("t"))),
    )
    ranks = metadata.sparkSession.range(writers).select(F.col("id").cast("string").alias("key"))
    absent = ranks.join(stats.where(rank), "key", "left_anti").select(F.inline(F.array(problem("missing_metadata", F.col("key"), F.lit("no rows of this rank")))))
    return each.unionByName(totals.select(F.inline(F.array_compact(wrong)))).unionByName(absent)


def problem_summary(problems: DataFrame) -> list[str]:
    """Problems (rule, subject, detail) as one line a rule: its first subject, and how many there are.  What comes to the driver is as many rows as there are rules."""
    rows = problems.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.struct("subject", "detail")).alias("first")).orderBy("rule").collect()
    return [f"{r.rule} {r.first.subject}: {r.first.detail}" + (f" (the first of {r.n})" if r.n > 1 else "") for r in rows]


def problem_list(problems: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, problems)
