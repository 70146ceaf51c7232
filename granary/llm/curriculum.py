"""Mixing sources to target weights: a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stage_boundary

#: Words are [^\x20\x09-\x0D]+ .
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of a source's order by digest, so that running sums are made in pieces; a power of 16.
PIECES = 4096


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null.  Counted as starts of words, without making their list."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each source: in proportion to its weight, never over ``most`` times its size, the excess reshared.

    sizes has one row per source: (source, source_size).  Weights repeat over the sources by code point, null last.
    The fixed point of resharing is min(cap, level * weight); the level follows from the sources in order of cap over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = (F.row_number().over(order) - 1).alias("rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.select("*", rank).withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(all_rows) * float(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
    s = s.withColumn("settled", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    return s.withColumn("target", F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled") * F.col("weight"))))


def schedule_slope(rank: Column) -> Column:
    """Linear weight schedules: 1 + slope * (2t - 1) of the weight at time t in [0, 1]; sources rise, stay and fall in turn."""
    return F.element_at(F.array(F.lit(0.5), F.lit(0.0), F.lit(-0.5)), (rank % 3 + 1).cast("int"))


def invert_demand(x: Column, slope: Column) -> Column:
    """The time at which the share x of a source's tokens has been asked for.

    The schedule's integral is (1 - slope) t + slope t^2; this is its inverse on [0, 1], also for slope 0.
    """
    a = 1 - slope
    return F.least(F.lit(1.0), 2 * x / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 4 * slope * x))))


def mix_sources(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mix all documents to target weights and give each its training positions.

    A source's documents stand in the order of their id's digest.  Whole passes over them are taken as often as they fit the target, then
    words from the order's start until it is met, the last document in part; so the taken words meet the target within one word, for most >= 1 no
    document gives more than ``ceil(most)`` times its size, and reruns agree.  Position: where in [0, 1] the source's cumulative demand under
    its schedule reaches the document's words in the pass, first pass first.  The result is range-sorted by first position.

    Running sums are of digest ranges first and of rows inside a range second, so a source with a third of all rows is many tasks' work.
    Rows of equal ids are told apart by size and a row number; a null id has a digest of its own.  A null source is a source, the last.
    Null texts have size 0, take nothing and stand at their place's position.  An empty table gives no rows; sources of no words have target 0.
    ``keep`` names further columns to carry, others are ignored; one that is named as a column of the result comes back as ``kept_`` and its name.
    Texts of any length are read whole.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)))
    rows = rows.withColumn("digest", digest).withColumn("piece", F.substring("digest", 1, len(hex(PIECES - 1)) - 2))
    if not keep:
        rows = stage_boundary(rows)
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    shares = capped_shares(pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size")), weights, share, most)
    up_to = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    plan = pieces.withColumn("piece_start", F.coalesce(F.sum("piece_size").over(up_to), F.lit(0)).cast("long"))
    plan = plan.join(shares.select(F.col("source").alias("_s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "piece_size")
    plan = plan.select(F.col("source").alias("_s"), F.col("piece").alias("_p"), "piece_start", "rank", "source_size", "target")
    inside = Window.partitionBy("source", "piece").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p"))).drop("_s", "_p")
    words = F.round("target").cast("long")
    rows = rows.withColumn("start", F.col("piece_start") + F.col("inside"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    rest = words - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    rows = rows.withColumn("taken", (F.col("size") * F.col("passes") + part).cast("long"))
    slope = schedule_slope(F.col("rank"))
    copies = F.sequence(F.lit(0), (F.col("passes") - F.when(part > 0, 0).otherwise(1)).cast("int"))
    at = F.transform(copies, lambda k: invert_demand(F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))), slope))
    rows = rows.withColumn("positions", F.when(F.col("taken") > 0, at).otherwise(F.array().cast("array<double>")))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    rows = rows.withColumn("position", first)
    own = ("size", "source_size", "target", "taken", "position", "positions")
    carried = [F.col(f"_keep{k}").alias(f"kept_{c}" if c in ("doc_id", "source", *own) else c) for k, c in enumerate(keep)]
    return rows.repartitionByRange("position", "digest").sortWithinPartitions("position", "digest").select("doc_id", "source", *carried, *own)
