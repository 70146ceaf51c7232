"""Record construction from JSON rows, with missing and null kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import marker_cut, first_sentence, qa_prompt, strip

VIEWS = ("full", "first_sentence")


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _has(v: Column, name: str) -> Column:
    return _get(v, name).isNotNull()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _plain(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _scalar(v: Column) -> Column:
    """Text of a JSON scalar as Python writes it (None, True, False, 1.0); missing is "".

    Doubles with a fraction or an exponent keep Spark's digits, which may differ from Python's in extreme values.
    """

    def text(v: Column) -> Column:
        kind, plain = _kind(v), F.coalesce(_plain(v), F.lit(""))
        whole = (kind == "DOUBLE") & ~plain.rlike("[.eE]")
        return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(plain)).when(whole, F.concat(plain, F.lit(".0"))).otherwise(plain)

    return _let(v, text)


def first_present(v: Column, *names: str) -> Column:
    """The value of the first name that is a key, null or not: a null stops the chain."""
    out = F.lit(None).cast("variant")
    for name in reversed(names):
        out = F.when(_has(v, name), _get(v, name)).otherwise(out)
    return out


def _unwrapped(v: Column) -> Column:
    """An object gives its input_text, or else text; then a list its first element."""
    inner = _let(v, lambda x: F.when(_kind(x).startswith("OBJECT"), first_present(x, "input_text", "text")).otherwise(x))
    return _let(inner, lambda x: F.when(_kind(x).startswith("ARRAY"), F.try_variant_get(x, "$[0]", "variant")).otherwise(x))


def _integer(v: Column) -> Column:
    """An integer label: numbers are truncated, true is 1, digits in text count; null and missing give null; anything else raises."""

    def number(v: Column) -> Column:
        kind, plain = _kind(v), _plain(v)
        value = F.when(kind == "BOOLEAN", (plain == "true").cast("int")).when(kind == "STRING", F.when(plain.rlike(r"^\s*[+-]?\d+\s*$"), plain.try_cast("int"))).otherwise(plain.try_cast("double").cast("int"))
        return F.when(kind.isin("", "VOID"), F.lit(None).cast("int")).otherwise(F.coalesce(value, F.raise_error(F.lit("label is no integer")).cast("int")))

    return _let(v, number)


def normalize_records(rows: DataFrame, json: str = "value", index: str = "source_index", text_column: str = "text", answer_column: str = "best_answer", view: str = "full", strict: bool = True) -> DataFrame:
    """One record per JSON row: source_index, text, question, answer, context, label, original_answer.

    A row whose text is neither missing, null nor "" is pre-joined and its text goes through unchanged, whatever the view.
    Others are joined from context, question and answer; the view decides whether the answer is cut to its first sentence.
    strict raises on a row without question or answer; else such rows have ``rejected`` set and null text.
    """
    if view not in VIEWS:
        raise ValueError(f"view must be one of {VIEWS}, not {view!r}")
    v = F.col("v")
    r = rows.select(F.col(index).cast("long").alias("source_index"), F.parse_json(F.col(json)).alias("v"))
    r = r.select(
        "source_index", _get(v, text_column).alias("t"), _get(v, "question").alias("q"), first_present(v, "context", "story").alias("c"), _get(v, "label").alias("l"),
        first_present(v, answer_column, "answer").alias("g"), first_present(v, answer_column, "answer", "answers").alias("n"),
    )
    present = _let(F.col("t"), lambda t: ~_kind(t).isin("", "VOID") & (F.coalesce(_plain(t), F.lit("?")) != ""))
    r = r.withColumn("joined", present)
    r = r.select("source_index", "joined", _scalar(F.col("t")).alias("whole"), _scalar(F.col("q")).alias("question"), _scalar(F.col("c")).alias("context"), _integer(F.col("l")).alias("label"), F.when(F.col("joined"), _scalar(F.col("g"))).otherwise(_scalar(_unwrapped(F.col("n")))).alias("original_answer"))
    cut = first_sentence(marker_cut(F.col("original_answer"))) if view == "first_sentence" else F.col("original_answer")
    r = r.withColumn("answer", F.when(F.col("joined"), F.col("original_answer")).otherwise(cut))
    empty = ~F.col("joined") & ((strip(F.col("question")) == "") | (strip(F.col("answer")) == ""))
    whole = F.when(F.col("joined"), F.col("whole")).otherwise(F.concat(qa_prompt(F.col("context"), F.col("question")), F.lit(" "), F.col("answer")))
    error = F.raise_error(F.concat(F.lit("row "), F.col("source_index").cast("string"), F.lit(f" needs {text_column}, or question and {answer_column}")))
    text = F.when(empty, error.cast("string") if strict else F.lit(None).cast("string")).otherwise(whole)
    out = r.withColumn("rejected", empty).withColumn("text", text)
    return out.select("source_index", "text", "question", "answer", "context", "label", "original_answer", *([] if strict else ["rejected"]))


def with_digest(records: DataFrame, text: str = "text") -> DataFrame:
    return records.withColumn("input_sha256", F.sha2(F.col(text), 256))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Structured records of a chat table: a user turn with the assistant's next one, and the system turn, if any, as context."""
    c = conversations
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("best_answer"))
    system = c.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("context"))
    return user.join(reply, ["conv_id", "turn"]).join(system, "conv_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
