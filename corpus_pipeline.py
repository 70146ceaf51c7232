"""From raw documents to a training mix, in five stages; part of the subpackage granary.llm."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.curriculum import mix_sources
from granary.llm.decontamination import drop_leaks
from granary.llm.jaccard_join import keep_one
from granary.llm.line_dedup import dedup_lines
from granary.llm.quality_ranking import score_quality
from granary.sources import read_table, shared_folder
from granary.sources.jsonl import remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts, by their whole texts; of repeated rows all stay or none.  Null texts are scored as empty ones.  An empty table gives no rows."""
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the first of each set of similar lines alone; rows of equal id and text are one document, each returned.

    Null texts become empty, texts of any length are cut line by line, and n_chars is that of what is left.  An empty table gives no rows.
    """
    out = dedup_lines(docs, keep=tuple(c for c in COLUMNS if c != "text" and c != "n_chars"))
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links, its first by id; of rows equal in id and text one stays.

    Documents without words, null texts among them, are linked with nothing and stay.  Texts are compared whole.  An empty table gives no rows.
    """
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item anywhere; of repeated rows all stay or none, null texts stay.  An empty benchmark takes none."""
    return drop_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, range-sorted by first training position; positions has that of each pass.

    Texts without words are not taken, a null source is a source of its own, repeated rows are documents of their own.  An empty table gives no rows.
    """
    mixed = mix_sources(docs, keep=("text", "lang", "n_chars")).where("taken > 0")
    return mixed.select(*COLUMNS, "size", "taken", F.round("position", 9).alias("position"), F.transform("positions", lambda p: F.round(p, 9)).alias("positions"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages learn, hash and align: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again as the next one's input.

    A stage's input is deleted once its result is written, so that two copies of the corpus at most are there; the last stage's input stays, as the result reads it.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
