"""Places and running sums in a sorted table, with DataFrame operations only.

The rows are dealt by ranges of their order, so a group that holds a third of all rows is spread over
many partitions. What lies before a row is a sum inside its piece, the rows of one group in one
partition, plus the sums of the earlier pieces of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meritgrid.llm.common import stored

ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below


def with_row(df: DataFrame, name: str, column: str = "row_id") -> DataFrame:
    """``df`` written with a number for every row, so that equal rows can be told apart."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, group: str, order: Sequence[str], value: str | None = None) -> DataFrame:
    """``df`` with ``place`` (from 0) in its group's order and ``in_group``, the rows of the group.

    With ``value`` also ``before`` and ``group_sum``: the sums of that column over the rows before
    and over the whole group. ``group`` must not be null and ``order`` should end with a column that
    is different in every row, or rows equal in it stay in one partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("_mid", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_mid", ROW_BITS)), "places")
    sums = [F.count("*").alias("_rows"), F.min("_mid").alias("_first")]
    sums += [F.sum(value).alias("_sum")] if value else []
    pieces = dealt.groupBy(group, "_part").agg(*sums)
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    columns = {
        "_rows_before": F.coalesce(F.sum("_rows").over(earlier), zero),
        "in_group": F.sum("_rows").over(whole),
    }
    if value:
        columns["_sum_before"] = F.coalesce(F.sum("_sum").over(earlier), zero)
        columns["group_sum"] = F.coalesce(F.sum("_sum").over(whole), zero)
    # stored, so that Spark knows its size when it chooses the join: a row for each piece
    pieces = stored(pieces.select(group, "_part", "_first", *[c.alias(n) for n, c in columns.items()]), "pieces")
    if value:
        piece = Window.partitionBy("_slot", "_part", group).orderBy("_mid")
        inside = piece.rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("_slot", F.pmod("_part", F.lit(parts)).cast("int"))
        dealt = dealt.repartitionById(parts, F.col("_slot"))  # one part to a task, where hashes collide
        dealt = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
    out = dealt.join(pieces, [group, "_part"])
    out = out.withColumn("place", F.col("_rows_before") + F.col("_mid") - F.col("_first"))
    if value:
        out = out.withColumn("before", F.col("_sum_before") + F.col("_inside"))
    return out.drop("_mid", "_part", "_slot", "_first", "_rows_before", "_sum_before", "_inside")
