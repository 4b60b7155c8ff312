"""Ranks and running totals over a whole table without a single-task window.

``place`` sorts the table by range partitioning and fixes partition and position of every row in
a checkpoint. Ranks are then position plus the row counts of earlier partitions; ranks inside a
group use (group, partition) pieces, so a group holding a third of all rows is still spread over
every partition it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.session import cut_lineage

ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below


def place(df: DataFrame, *order: Column | str) -> DataFrame:
    """Globally sorted table with ``_pid`` and 1-based ``_pos`` fixed by a checkpoint."""
    placed = df.sort(*order).withColumn("_mid", F.monotonically_increasing_id())
    fixed = cut_lineage(placed)
    return (
        fixed.withColumn("_pid", F.shiftright("_mid", ROW_BITS))
        .withColumn("_pos", F.col("_mid") - F.shiftleft("_pid", ROW_BITS) + 1)
        .drop("_mid")
    )


def _before(per_piece: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of ``value`` over earlier partitions, per group; one row per (group, partition)."""
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return per_piece.withColumn("_before", F.coalesce(F.sum(value).over(earlier), F.lit(0))).withColumn(
        "_total", F.sum(value).over(whole)
    )


def global_rank(placed: DataFrame, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Row number over the whole placed table."""
    pieces = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row per sort partition: bounded by the partition count, whatever the data size
    offsets = F.broadcast(_before(pieces, [], "_n").drop("_n"))
    out = placed.join(offsets, "_pid").withColumn(rank, F.col("_before") + F.col("_pos"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_before", "_total")


def group_rank(placed: DataFrame, keys: Sequence[str], rank: str, total: str | None = None) -> DataFrame:
    """Row number inside each group, in the placed order; keys must not be null."""
    keys = list(keys)
    pieces = placed.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    offsets = _before(pieces, keys, "_n").drop("_n")
    piece = Window.partitionBy(*keys, "_pid").orderBy("_pos")
    out = (
        placed.join(offsets, [*keys, "_pid"])
        .withColumn("_in", F.row_number().over(piece))
        .withColumn(rank, F.col("_before") + F.col("_in"))
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_before", "_total", "_in")


def running_sum(placed: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including the row, in the placed order."""
    pieces = placed.groupBy("_pid").agg(F.sum(value).alias("_n"))
    offsets = F.broadcast(_before(pieces, [], "_n").drop("_n", "_total"))
    upto = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, "_pid")
        .withColumn(out, F.col("_before") + F.sum(value).over(upto))
        .drop("_before")
    )


def unplaced(df: DataFrame) -> DataFrame:
    return df.drop("_pid", "_pos")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """First k rows per group; Spark prunes each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return ranked.drop("_rn")
