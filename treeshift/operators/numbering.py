"""Positions of rows in ordered groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from treeshift.session import cut


def number_rows(
    df: DataFrame, by: list[str], order: list[str], name: str = "position"
) -> DataFrame:
    """0-based position of each row in its ``by`` group, ordered by ``order``.

    A ``row_number`` window puts a whole group in one task. Here the rows are
    range-sorted over all tasks and written, counted per (group, partition),
    and each row's position is its place in its own partition plus the group's
    rows in earlier partitions. ``order`` has to be a total order of a group.
    """
    ordered = cut(df.orderBy(*by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition continues at most one group, so this holds at most one row
    # per partition and is safe to broadcast
    carried = (
        ordered.groupBy(*by, "_part")
        .count()
        .withColumn("_before", F.sum("count").over(before))
        .filter("_before > 0")
        .drop("count")
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        ordered.withColumn("_local", F.row_number().over(inside))
        .join(F.broadcast(carried), [*by, "_part"], "left")
        .withColumn(name, F.col("_local") - 1 + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_part", "_local", "_before")
    )
