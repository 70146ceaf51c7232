"""Ordinals, strided partitions, batches and greedy shards, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import join_spans, lay_out, position, spans

_SPAN = ("_place", "_first", "_n", "_before", "_rows")


def _present(key: str) -> Column:
    """The key; a null one raises."""
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} is null")).cast("long"))


def with_ordinal(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "ordinal", computed: bool = True) -> DataFrame:
    """Position of each row by an integer key, from 0, within each group of ``by``.

    Rows are laid out in sampled ranges of (by, key); a position is the place in the range plus the group's rows in earlier ranges, so no task
    sees more than a range.  Rows of equal keys are numbered in any order; a null key raises.  A df that isn't computed, but scanned, is read twice.
    """
    laid = lay_out(df.withColumn(key, _present(key)), *by, key, computed=computed)
    return join_spans(laid, spans(laid, by), by).withColumn(name, position()).drop(*_SPAN)


def in_window(ordinal: Column, start: int = 0, most: int | None = None) -> Column:
    """Positions from start on, ``most`` of them; 0 and None mean all."""
    inside = ordinal >= start
    return inside & (ordinal < start + most) if most else inside


def rank_of(ordinal: Column, world: int, rank: int | None = None) -> Column:
    """The worker of a position, dealt in strides; with a rank, whether it is that worker's."""
    if world < 1 or (rank is not None and not 0 <= rank < world):
        raise ValueError("rank must be below the number of workers")
    mine = F.pmod(ordinal, F.lit(world)).cast("int")
    return mine if rank is None else mine == rank


def _batched(df: DataFrame, key: str, bucket: str, by: Sequence[str], computed: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows in the order of (by, bucket, key), the spans of their groups, and the groups' columns."""
    groups = [*by, bucket]
    laid = lay_out(df.withColumn(key, _present(key)), *groups, key, computed=computed)
    return laid, spans(laid, groups), groups


def _batch_columns(rows: DataFrame, batch: int) -> DataFrame:
    out = rows.withColumn("bucket_ordinal", position())
    out = out.withColumn("batch_id", F.floor(F.col("bucket_ordinal") / batch).cast("long"))
    last = F.floor((F.col("_rows") - 1) / batch)
    return out.withColumn("batch_pad", F.when(F.col("batch_id") == last, F.pmod(-F.col("_rows"), F.lit(batch))).otherwise(0).cast("int"))


def with_batches(df: DataFrame, batch: int, key: str = "source_index", bucket: str = "bucket", by: Sequence[str] = (), computed: bool = True) -> DataFrame:
    """bucket_ordinal and batch_id of each row inside its bucket, by key; batch_pad: rows that fill the bucket's last batch."""
    laid, table, groups = _batched(df, key, bucket, by, computed)
    return _batch_columns(join_spans(laid, table, groups), batch).drop(*_SPAN)


def _fold_shards(summary: DataFrame, batch: int, shard: int, by: Sequence[str], bucket: str, first: int) -> DataFrame:
    """State at each bucket's start: shard number, rows in the open shard, rows before.

    Buckets are few, and inside one all batches but the last are full, so shards close at a fixed stride; the fold steps over buckets, not batches.
    """
    per = -(-shard // batch)
    entries = F.array_sort(F.collect_list(F.struct(F.col(bucket).cast("int").alias("bucket"), F.col("n"))))
    start = F.struct(F.lit(first).cast("long").alias("k"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("seen"), F.expr("cast(array() as array<struct<bucket: int, n: long, k: long, r: long, seen: long>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full, part = F.floor(x["n"] / batch).cast("long"), F.pmod(x["n"], F.lit(batch)).cast("long")
        need = F.ceil((F.lit(shard) - acc["r"]) / batch).cast("long")
        closed = F.when(full >= need, 1 + F.floor((full - need) / per)).otherwise(0).cast("long")
        open_rows = F.when(full < need, acc["r"] + full * batch).otherwise(F.pmod(full - need, F.lit(per)) * batch) + part
        done = (part > 0) & (open_rows >= shard)
        here = F.struct(x["bucket"].alias("bucket"), x["n"].alias("n"), acc["k"].alias("k"), acc["r"].alias("r"), acc["seen"].alias("seen"))
        return F.struct(
            (acc["k"] + closed + F.when(done, 1).otherwise(0)).cast("long").alias("k"),
            F.when(done, 0).otherwise(open_rows).cast("long").alias("r"),
            (acc["seen"] + x["n"]).cast("long").alias("seen"),
            F.array_append(acc["out"], here).alias("out"),
        )

    return summary.groupBy(*by).agg(entries.alias("e")).select(*by, F.inline(F.aggregate("e", start, step, lambda acc: acc["out"])))


def with_shards(df: DataFrame, batch: int, shard: int, key: str = "source_index", bucket: str = "bucket", by: Sequence[str] = (), first: int = 0, computed: bool = True) -> DataFrame:
    """Greedy shards of the batches in (bucket, batch) order: a shard closes once it has ``shard`` rows or more, and may span buckets.

    Adds bucket_ordinal, batch_id, batch_pad, shard (numbers from ``first``) and offset in the shard.  ``by`` names the writer's columns.
    """
    laid, table, groups = _batched(df, key, bucket, by, computed)
    sizes = table.groupBy(*groups).agg(F.first("_rows").alias("n"))
    state = _fold_shards(sizes, batch, shard, by, bucket, first)
    state = state.select(*by, F.col("bucket").cast(dict(df.dtypes)[bucket]).alias(bucket), F.col("k").alias("_k"), F.col("r").alias("_r"), F.col("seen").alias("_seen"))
    rows = _batch_columns(join_spans(laid, table.join(state, groups), groups), batch)
    per = -(-shard // batch)
    need = F.ceil((F.lit(shard) - F.col("_r")) / batch).cast("long")
    late = F.col("batch_id") >= need
    step = F.floor((F.col("batch_id") - need) / per).cast("long")
    number = F.when(late, F.col("_k") + 1 + step).otherwise(F.col("_k"))
    begin = F.when(late, (need + step * per) * batch).otherwise(-F.col("_r"))
    out = rows.withColumn("shard", number.cast("long")).withColumn("offset", (F.col("bucket_ordinal") - begin).cast("long"))
    return out.drop("_k", "_r", "_seen", *_SPAN)


def shard_name(number: Column, rank: Column | None = None) -> Column:
    own = F.format_string("shard-%05d", number)
    return own if rank is None else F.concat(F.format_string("rank-%03d/", rank), own)


def shard_number(name: Column) -> Column:
    return F.regexp_extract(name, r"shard-(\d+)", 1).try_cast("long")


def next_shard(numbers: DataFrame, column: str = "shard") -> DataFrame:
    """One row: the number behind the largest, 0 without any."""
    return numbers.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).cast("long").alias("next_shard"))
