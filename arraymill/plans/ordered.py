"""Positions and running sums over a whole table without a one-task window.

A range partitioning puts the rows in order; each partition is numbered as it lies or summed by itself,
and the totals of the partitions before it, one row a partition, are added. Both passes read one kept
copy of the partitioning, for a plan that runs twice may sample other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """Rows in order within their range, with its number and their place in it, kept, since each run of the
    plan may cut other ranges. An id holds the partition above 33 bits and the place below."""
    rows = df.repartitionByRange(partitions or _parts(df), *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("_ordered_id", F.monotonically_increasing_id()))
    return rows.withColumn("_ordered_part", F.shiftright("_ordered_id", 33)).withColumn("_ordered_at", F.col("_ordered_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_ordered_id")


def ranked(df: DataFrame, *order: Column | str, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in the order, which must be total. One shuffle and one sort."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = _dealt(df, order, partitions)
    ahead = _ahead(dealt.groupBy("_ordered_part").agg(F.count("*").alias("_ordered_total")))
    return dealt.join(F.broadcast(ahead), "_ordered_part").withColumn(name, F.col("_ordered_at") + F.col("_ordered_ahead")).drop("_ordered_part", "_ordered_ahead", "_ordered_at")


def running_sum(df: DataFrame, value: Column, *order: Column | str, name: str = "running", partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of the value over all rows up to and with its own."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = _dealt(df.withColumn("_ordered_v", value), order, partitions)
    ahead = _ahead(dealt.groupBy("_ordered_part").agg(F.sum("_ordered_v").alias("_ordered_total")))
    own = F.sum("_ordered_v").over(Window.partitionBy("_ordered_part").orderBy("_ordered_at").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, own).join(F.broadcast(ahead), "_ordered_part").withColumn(name, F.col(name) + F.col("_ordered_ahead")).drop("_ordered_part", "_ordered_ahead", "_ordered_at", "_ordered_v")


def _ahead(totals: DataFrame) -> DataFrame:
    """For each partition the sum of the totals before it; as many rows as partitions."""
    before = Window.partitionBy(F.lit(0)).orderBy("_ordered_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_ordered_part", F.coalesce(F.sum("_ordered_total").over(before), F.lit(0)).alias("_ordered_ahead"))
