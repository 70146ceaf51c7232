"""Positions of rows in a global order, by sampled ranges and a two-pass prefix sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage_boundary

#: A row's place in a layout: the range's number above these bits, the row's number in its range below.
PIECE_BITS = 33


def lay_out(df: DataFrame, *order: str | Column, computed: bool = True) -> DataFrame:
    """df in ranges of the order's columns that Spark cuts at sampled quantiles, sorted inside, with ``_place``, a number that ascends in the order.

    Ranges are even whatever the keys' distances; one far key doesn't widen them.  The layout is written to the shared folder, so places are the
    same for every reader.  Cutting the ranges reads df once more than sorting does: where it is computed, it is written first, so that the work
    behind it runs once; a plain scan needn't be.  Rows that are equal in all columns of the order stay in one range.
    """
    df = stage_boundary(df) if computed else df
    return stage_boundary(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))


def piece_of(place: str = "_place") -> Column:
    return F.shiftright(place, PIECE_BITS)


def spans(laid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, _piece, _first, _n, _before, _rows): a row per range and group: its first place, its rows, the group's rows in earlier ranges and in all.

    Only these rows are windowed, one per range that a group lies in; a layout's order must begin with the group's columns.
    """
    counts = laid.groupBy(*by, piece_of().alias("_piece")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_piece", "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_rows"))


def join_spans(laid: DataFrame, table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of a layout with their span's columns; null groups match.  A group with many rows has many spans, so no key of this join is hot."""
    if not by:
        return laid.withColumn("_piece", piece_of()).join(F.broadcast(table), "_piece").drop("_piece")
    own = laid.withColumn("_piece", piece_of())
    other = table.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_piece").alias("_p"), *(c for c in table.columns if c not in (*by, "_piece")))
    met = F.col("_piece") == F.col("_p")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return own.join(other, met).drop("_piece", "_p", *(f"_by{i}" for i in range(len(by))))


def position() -> Column:
    """A row's position in its group, from 0, once its span is joined."""
    return (F.col("_before") + F.col("_place") - F.col("_first")).cast("long")
