"""Sets that keep repeats: values are counted, counts are combined, and places follow from running counts.

A value that many rows share is one row until the end, where its repeats are dealt out in pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running_sum
from .cumulative import roll
from .grid import Grid

#: Repeats of a value that one row is spread to at a time.
PIECE = 1 << 16


def _combined(a: Grid, b: Grid, f: Callable[[Column, Column], Column]) -> Grid:
    both = a.df.select("value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.df.select("value", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    kept = counts.select("value", f(F.col("a"), F.col("b")).cast("long").alias("times")).filter("times > 0")
    placed = running_sum(kept, F.col("times"), "value", name="until")
    size = kept.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    start, times = F.col("until") - F.col("times"), F.col("times")
    pieces = placed.select("value", start.alias("start"), times.alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1, F.lit(PIECE).cast("long"))).alias("piece")).repartition("value", "piece")
    rows = pieces.select("value", F.explode(F.sequence(F.col("start") + F.col("piece"), F.col("start") + F.least(F.col("piece") + PIECE, F.col("times")) - 1)).alias("col"))
    return Grid(rows.select(F.lit(0).cast("long").alias("row"), "col", "value"), 1, size)


def set_union(a: Grid, b: Grid) -> Grid:
    """Each value as often as in the side that has it more often."""
    return _combined(a, b, F.greatest)


def set_intersection(a: Grid, b: Grid) -> Grid:
    """Each value as often as both sides have it."""
    return _combined(a, b, F.least)


def set_difference(a: Grid, b: Grid) -> Grid:
    """What is left of the first side when each value of the second takes one away."""
    return _combined(a, b, lambda x, y: F.greatest(x - y, F.lit(0)))


def set_symmetric_difference(a: Grid, b: Grid) -> Grid:
    return _combined(a, b, lambda x, y: F.abs(x - y))


def merge(a: Grid, b: Grid) -> Grid:
    """All values of both sides in order."""
    return _combined(a, b, lambda x, y: x + y)


def minmax_element(x: Grid) -> DataFrame:
    """``first_min, last_max``: flat positions of the first least and the last greatest value."""
    least, most = F.min(F.struct("value", x.idx.alias("at"))), F.max(F.struct("value", x.idx.alias("at")))
    return x.df.agg(least["at"].alias("first_min"), most["at"].alias("last_max"))


def rotate(x: Grid, n: int) -> Grid:
    """The flattened values with the n-th one first."""
    return roll(x, -n)
