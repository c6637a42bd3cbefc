"""Positions in a global order without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.session import materialise


def with_positions(
    df: DataFrame, order: Sequence[Column], name: str, ties: bool = False
) -> DataFrame:
    """Append the position of each row in the given order, from 0.

    With ``ties``, rows that are equal in the order get the position of their first one. Rows are
    range-partitioned by the order, numbered inside each range, and shifted by the number of rows
    in earlier ranges; there are as many ranges as shuffle partitions.
    """
    placed = materialise(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    number = F.rank() if ties else F.row_number()
    return (
        placed.withColumn("_inside", number.over(inside))
        .join(starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .select(*df.columns, name)
    )
