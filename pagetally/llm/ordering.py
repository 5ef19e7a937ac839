"""Positions of all rows in one global order, from totals of range-dealt parts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def dealt_in_order(rows: DataFrame, order: list[Column], what: str) -> DataFrame:
    """The rows range-dealt by `order` and written with `part`, the number of their range.

    Rows equal in all of `order` stay in one part, so let it end with a column that tells rows apart.
    """
    return written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), what)


def with_positions(dealt: DataFrame, order: list[Column], size: Column | None = None) -> DataFrame:
    """Adds row (from 1) and rows (of the table), and with `size` start (the sum of it over all rows before) and total.

    One row per part is summed in one task; within parts, windows count. No task sees more than a part.
    """
    size = F.lit(1) if size is None else size
    everywhere = Window.orderBy("part")
    before = everywhere.rowsBetween(Window.unboundedPreceding, -1)
    all_parts = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("size_before"),
        F.sum("n").over(all_parts).alias("rows"),
        F.sum("bytes").over(all_parts).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("row", F.row_number().over(inside).cast("long"))
        .withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .join(totals, "part")
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .withColumn("start", F.col("start") + F.col("size_before"))
        .drop("part", "rows_before", "size_before")
    )
