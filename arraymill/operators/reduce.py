"""Reductions of a grid along an axis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Axis, Grid


def reduce(x: Grid, f: Callable[[Column], Column], axis: Axis = Axis.NONE) -> DataFrame:
    """``value`` of the whole grid, or ``row, value`` / ``col, value`` along an axis."""
    return x.df.groupBy(*axis.keys).agg(f(F.col("value")).alias("value"))


def cube(x: Grid, f: Callable[[Column], Column]) -> DataFrame:
    """The reduction along both axes and of the whole in one pass: ``row, col, value``, null where reduced."""
    return x.df.groupingSets([["row"], ["col"], []], "row", "col").agg(f(F.col("value")).alias("value"))


def arg_extreme(x: Grid, axis: Axis = Axis.NONE, largest: bool = True, nan_safe: bool = False) -> DataFrame:
    """Position of the first extreme value: flat for the whole, else along the axis."""
    at = x.idx if axis is Axis.NONE else F.col(axis.along[0])
    value = F.col("value")
    key = F.struct((-value if largest else value).alias("v"), at.alias("at"))
    rows = x.df.filter(~F.isnan(value)) if nan_safe else x.df
    return rows.groupBy(*axis.keys).agg(F.min(key)["at"].alias("value"))


def argmax(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    return arg_extreme(x, axis)


def argmin(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    return arg_extreme(x, axis, largest=False)


def nanargmax(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    return arg_extreme(x, axis, nan_safe=True)


def nanargmin(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    return arg_extreme(x, axis, largest=False, nan_safe=True)


def center_of_mass(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    """Mean position weighted by value: row and column of the whole, else one position an axis."""
    v = F.col("value")
    mean = lambda c: F.sum(v * F.col(c)) / F.sum(v)
    if axis is Axis.NONE:
        return x.df.agg(mean("row").alias("row"), mean("col").alias("col"))
    return x.df.groupBy(*axis.keys).agg(mean(axis.along[0]).alias("value"))


def trace(x: Grid, offset: int = 0, axis: Axis = Axis.ROW) -> DataFrame:
    """Sum of a diagonal; by rows an offset counts downwards, by columns to the right."""
    side = F.col("row") - F.col("col") if axis is Axis.ROW else F.col("col") - F.col("row")
    return x.df.filter(side == offset).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def _both(a: Grid, b: Grid) -> Grid | None:
    return None if a.shape != b.shape else a.zip(b, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def allclose(a: Grid, b: Grid, tolerance: float = 1e-5) -> DataFrame:
    """Whether all pairs lie within an absolute tolerance."""
    pairs = _both(a, b)
    if pairs is None:
        raise ValueError("shapes differ")
    return pairs.df.agg(F.coalesce(F.bool_and(F.abs(F.col("value.a") - F.col("value.b")) <= tolerance), F.lit(True)).alias("value"))


def array_equal(a: Grid, b: Grid) -> DataFrame:
    from ..functions.numeric import essentially_equal

    pairs = _both(a, b)
    if pairs is None:
        return a.df.sparkSession.range(1).select(F.lit(False).alias("value"))
    return pairs.df.agg(F.coalesce(F.bool_and(essentially_equal(F.col("value.a"), F.col("value.b"))), F.lit(True)).alias("value"))


def array_equiv(a: Grid, b: Grid) -> DataFrame:
    """Equality of the flattened grids."""
    from .layout import flatten

    return array_equal(flatten(a), flatten(b))


def issorted(x: Grid) -> DataFrame:
    """Whether the flattened values never fall."""
    from ..plans.ordered import ranked

    rows = ranked(x.df.select(x.idx.alias("at"), "value"), "at")
    after = rows.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("next"))
    return rows.join(after, "idx").agg(F.coalesce(F.bool_and(F.col("next") >= F.col("value")), F.lit(True)).alias("value"))
