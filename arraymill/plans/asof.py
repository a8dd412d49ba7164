"""As-of joins in one ordered pass over both sides.

Rows of both sides are dealt out together by ranges of the order; inside a range the last edge before a
row is a running aggregate, and the last edge of the ranges before it is carried over, one row a range.
Neither side is sent to every task, and equal places are spread over ranges by a further key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _dealt, _parts

#: Rows of a range, which a task sorts and keeps: there are more ranges where there are more rows.
RANGE_ROWS = 1 << 19


def bracket(left: DataFrame, edges: DataFrame, on: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``left`` with the ``edges`` row at or before its place, the one after it, and the edge's number.

    Adds ``below`` and ``above``, structs of the edges' columns other than ``by``, null where there is none
    of equal ``by``, and ``edges``, the number of edges up to the place in the order of ``by`` and place.
    Of equal edges the greatest by its columns is below. A place that is null or NaN has neither; edges
    at such places are left out.
    """
    by = by or []
    keys, payload = [f"_by_{c}" for c in by], [c for c in edges.columns if c not in by]
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "NaN")
    marks = edges.filter(known(on)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(on).alias("_on"), F.lit(0).alias("_side"), F.struct(*payload).alias("_edge"))
    own = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    # the last key spreads rows of one place over ranges and has no say in what they get
    both = own.unionByName(marks, allowMissingColumns=True)
    partitions = partitions or max(_parts(left), -(-both.count() // RANGE_ROWS))
    both = both.withColumn("_deal", F.monotonically_increasing_id())
    rows = _dealt(both, [F.col(c) for c in (*keys, "_on", "_side", "_edge", "_deal")], partitions)
    is_edge = F.col("_side") == 0
    mark = F.when(is_edge, F.struct(*keys, F.col("_edge").alias("edge")))
    part = Window.partitionBy("_ordered_part").rowsBetween(Window.unboundedPreceding, 0)
    rising, falling = part.orderBy("_ordered_at"), part.orderBy(F.col("_ordered_at").desc())
    # the windows would else deal ranges to as many tasks as the session's setting says
    rows = rows.repartition(partitions, "_ordered_part").withColumns({"_last": F.last(mark, ignorenulls=True).over(rising), "_count": F.count_if(is_edge).over(rising), "_next": F.last(mark, ignorenulls=True).over(falling)})
    ends = rows.groupBy("_ordered_part").agg(F.max_by(mark, F.when(is_edge, F.col("_ordered_at"))).alias("last"), F.min_by(mark, F.when(is_edge, F.col("_ordered_at"))).alias("next"), F.count_if(is_edge).alias("n"))
    # over a row for each range
    ranges = Window.partitionBy(F.lit(0)).orderBy("_ordered_part")
    before, behind = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_ordered_part", F.last("last", ignorenulls=True).over(before).alias("_carry_last"), F.first("next", ignorenulls=True).over(behind).alias("_carry_next"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_carry_count"))
    met = rows.filter("_side = 1").join(F.broadcast(carried), "_ordered_part")
    met = met.withColumns({"_last": F.coalesce("_last", "_carry_last"), "_next": F.coalesce("_next", "_carry_next")})
    edge = lambda m: F.when(known("_on") & _same([F.col(k) for k in keys], [F.col(m)[k] for k in keys]), F.col(m)["edge"])
    return met.select("_row.*", edge("_last").alias("below"), edge("_next").alias("above"), (F.col("_count") + F.col("_carry_count")).alias("edges"))


def _same(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out
