"""Positions in an order, without bringing an ordered group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut


def numbered_rows(df: DataFrame, order: list[Column], out: str = "__n") -> DataFrame:
    """``df`` plus its position (from 0) in the order: range-sorted partitions, each numbered from its own offset.

    The sorted table is written to the checkpoint folder first, so that both passes see the
    same partitions; offsets are one row a partition.
    """
    marked = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    sizes = marked.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), F.min("__i").alias("__first"))
    before = F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__offset", F.coalesce(before, F.lit(0))).drop("c")
    return marked.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__offset") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__offset", "__first")


def numbered_within(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """``df`` plus the position (from 1) within each value of ``key``; a value of any size is spread over its range partitions."""
    n = numbered_rows(df, [F.col(c) for c in (key, *order)])
    first = n.groupBy(key).agg(F.min("__n").alias("__low"))
    return n.join(first, key).withColumn(out, F.col("__n") - F.col("__low") + 1).drop("__n", "__low")
