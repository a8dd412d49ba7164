"""Running, neighbour and shifting operators.

Along an axis a window runs within each row or column. Over the whole grid running sums take two
passes over a range partitioning, and neighbours are met by position, so no task sees everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running_sum
from .grid import Axis, Grid


def _window(axis: Axis):
    return Window.partitionBy(*axis.keys).orderBy(*axis.along)


def cumsum(x: Grid, axis: Axis = Axis.NONE, nan_safe: bool = False) -> Grid:
    v = F.when(F.isnan("value"), 0.0).otherwise(F.col("value")) if nan_safe else F.col("value")
    if axis is Axis.NONE:
        rows = running_sum(x.df, v, "row", "col", name="_sum")
        return Grid(rows.select(F.lit(0).cast("long").alias("row"), x.idx.alias("col"), F.col("_sum").alias("value")), 1, x.size)
    own = F.sum(v).over(_window(axis).rowsBetween(Window.unboundedPreceding, 0))
    return Grid(x.df.withColumn("value", own), x.rows, x.cols)


def cumprod(x: Grid, axis: Axis = Axis.NONE, nan_safe: bool = False) -> Grid:
    """Running products; over the whole grid from running sums of logarithms, signs and zeros."""
    v = F.when(F.isnan("value"), 1.0).otherwise(F.col("value")) if nan_safe else F.col("value")
    if axis is Axis.NONE:
        rows = running_sum(x.df.withColumn("value", v), F.when(F.col("value") == 0, 0.0).otherwise(F.ln(F.abs("value"))), "row", "col", name="_log")
        rows = running_sum(rows, (F.col("value") < 0).cast("long") + F.shiftleft((F.col("value") == 0).cast("long"), 40), "row", "col", name="_signs")
        sign = F.when(F.col("_signs") >= 1 << 40, 0.0).when(F.col("_signs") % 2 == 1, -1.0).otherwise(1.0)
        return Grid(rows.select(F.lit(0).cast("long").alias("row"), x.idx.alias("col"), (sign * F.exp("_log")).alias("value")), 1, x.size)
    own = F.product(v).over(_window(axis).rowsBetween(Window.unboundedPreceding, 0))
    return Grid(x.df.withColumn("value", own), x.rows, x.cols)


def _shifted(x: Grid, by: int, axis: Axis, name: str) -> DataFrame:
    """``row, col, value`` with the value ``by`` places on; by position, so any size is dealt out."""
    if axis is Axis.NONE:
        at = x.idx - by
        other = x.df.select(F.floor(at / x.cols).cast("long").alias("row"), F.pmod(at, F.lit(x.cols)).alias("col"), F.col("value").alias(name))
    else:
        c = axis.along[0]
        other = x.df.select(*[(F.col(k) - by).alias(k) if k == c else F.col(k) for k in ("row", "col")], F.col("value").alias(name))
    return other


def diff(x: Grid, axis: Axis = Axis.NONE) -> Grid:
    """Each value's successor less itself."""
    rows = x.df.join(_shifted(x, 1, axis, "_next"), ["row", "col"]).withColumn("value", F.col("_next") - F.col("value")).drop("_next")
    if axis is Axis.NONE:
        return Grid(rows.select(F.lit(0).cast("long").alias("row"), x.idx.alias("col"), "value"), 1, max(x.size - 1, 0))
    return Grid(rows, x.rows - (axis is Axis.ROW), x.cols - (axis is Axis.COL))


def gradient(x: Grid, axis: Axis = Axis.ROW) -> Grid:
    """Central differences, one-sided at the ends."""
    rows = x.df.join(_shifted(x, 1, axis, "_next"), ["row", "col"], "left").join(_shifted(x, -1, axis, "_last"), ["row", "col"], "left")
    width = F.col("_next").isNotNull().cast("int") + F.col("_last").isNotNull().cast("int")
    value = (F.coalesce("_next", "value") - F.coalesce("_last", "value")) / width
    return Grid(rows.select("row", "col", value.alias("value")), x.rows, x.cols)


def roll(x: Grid, shift: int, axis: Axis = Axis.NONE) -> Grid:
    if axis is Axis.NONE:
        at = F.pmod(x.idx + shift, F.lit(x.size))
        return x.place(F.floor(at / x.cols), at % x.cols, x.rows, x.cols)
    moved = lambda c, n: F.pmod(F.col(c) + shift, F.lit(n))
    row, col = (moved("row", x.rows), F.col("col")) if axis is Axis.ROW else (F.col("row"), moved("col", x.cols))
    return x.place(row, col, x.rows, x.cols)


def trapz(x: Grid, dx: float = 1.0, axis: Axis = Axis.NONE, at: Grid | None = None) -> DataFrame:
    """Trapezoidal rule over steps of dx, or over the abscissae ``at`` (a grid of the same shape)."""
    step: Column = F.lit(float(dx))
    rows = x.df.join(_shifted(x, 1, axis, "_next"), ["row", "col"])
    if at is not None:
        here = at.df.select("row", "col", F.col("value").alias("_x"))
        rows = rows.join(here, ["row", "col"]).join(_shifted(at, 1, axis, "_xn"), ["row", "col"])
        step = F.col("_xn") - F.col("_x")
    return rows.groupBy(*axis.keys).agg(F.sum((F.col("value") + F.col("_next")) / 2 * step).alias("value"))
