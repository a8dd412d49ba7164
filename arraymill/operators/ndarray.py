"""Arrays of any rank: a lazy DataFrame ``at, value`` with a shape and an order beside it.

``at`` is the linear position. In order F the first axis runs fastest, in order C the last. An index along
an axis is an expression of the position, so reshaping costs nothing, reordering and transposing rewrite
positions, and a reduction over any axes groups by the position in what is left of the shape. Cells that
no row holds are absent until ``filled``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce as accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..plans.ordered import ranked
from .grid import Grid, Slice

ORDERS = ("F", "C")


def strides(shape: Sequence[int], order: str) -> list[int]:
    """What a step along each axis adds to the position."""
    if order not in ORDERS:
        raise ValueError("an order is F or C")
    n = range(len(shape))
    return [math.prod(shape[:k]) if order == "F" else math.prod(shape[k + 1 :]) for k in n]


def position(index: Sequence[Column], shape: Sequence[int], order: str) -> Column:
    """Linear position of an index."""
    parts = [i.cast("long") * F.lit(s) for i, s in zip(index, strides(shape, order), strict=True)]
    return accumulate(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def fold(f: Callable, first, *rest):
    """f over arrays, Columns or numbers from left to right."""
    return accumulate(f, rest, first)


def tsum(first, *rest):
    return fold(lambda a, b: a + b, first, *rest)


def tproduct(first, *rest):
    return fold(lambda a, b: a * b, first, *rest)


def tmin(first, *rest):
    return fold(lambda a, b: _least(a, b, F.least), first, *rest)


def tmax(first, *rest):
    return fold(lambda a, b: _least(a, b, F.greatest), first, *rest)


def _least(a, b, f):
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return a.zip(b, f) if isinstance(a, NDArray) else f(lit(a), lit(b))


@dataclass(frozen=True, eq=False)
class NDArray:
    """``base`` and ``expr`` say where the values come from: arrays made of the rows of one DataFrame, by
    ``columns`` or ``map``, meet as expressions without a join."""

    df: DataFrame
    shape: tuple[int, ...]
    order: str = "F"
    base: DataFrame | None = None
    expr: Column | None = None

    def __post_init__(self):
        strides(self.shape, self.order)
        if any(n < 0 for n in self.shape):
            raise ValueError("an axis has a negative length")

    # construction

    @staticmethod
    def of(df: DataFrame, shape: Sequence[int], *index: Column | str, value: Column | str = "value", order: str = "F") -> NDArray:
        """An array of rows with an integer index along each axis."""
        own = [F.col(i) if isinstance(i, str) else i for i in index]
        return NDArray(df.select(position(own, shape, order).alias("at"), (F.col(value) if isinstance(value, str) else value).alias("value")), tuple(shape), order)

    @staticmethod
    def columns(df: DataFrame, shape: Sequence[int], *values: Column, order: str = "F") -> list[NDArray]:
        """Arrays of several values of one table with a position ``at``."""
        return [NDArray._from(df, v, tuple(shape), order) for v in values]

    @staticmethod
    def _from(base: DataFrame, expr: Column, shape: tuple[int, ...], order: str) -> NDArray:
        return NDArray(base.select("at", expr.alias("value")), shape, order, base, expr)

    @staticmethod
    def from_function(spark: SparkSession, f: Callable[..., Column], shape: Sequence[int], order: str = "F") -> NDArray:
        """f of the index at every place, from one range."""
        empty = NDArray(spark.range(math.prod(shape)).select(F.col("id").alias("at"), F.lit(None).alias("value")), tuple(shape), order)
        return replace(empty, df=empty.df.select("at", f(*empty.index).alias("value")))

    @staticmethod
    def from_grid(x: Grid, order: str = "C") -> NDArray:
        return NDArray.of(x.df, x.shape, "row", "col", order=order)

    def to_grid(self) -> Grid:
        """A one- or two-dimensional array as a grid."""
        if len(self.shape) not in (1, 2):
            raise ValueError("a grid has one or two axes")
        row, col = (F.lit(0).cast("long"), self.index[0]) if len(self.shape) == 1 else self.index
        return Grid(self.df.select(row.alias("row"), col.alias("col"), "value"), *(self.shape if len(self.shape) == 2 else (1, *self.shape)))

    # places

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[Column]:
        """The index along each axis."""
        at = F.col("at")
        return [F.call_function("div", at, F.lit(s)) % F.lit(n) for s, n in zip(strides(self.shape, self.order), self.shape, strict=True)]

    def _axes(self, axes: int | Sequence[int] | None) -> list[int]:
        own = range(self.rank) if axes is None else [axes] if isinstance(axes, int) else axes
        out = sorted({a + self.rank if a < 0 else a for a in own})
        if any(not 0 <= a < self.rank for a in out):
            raise ValueError("no such axis")
        return out

    def _placed(self, index: Sequence[Column], shape: Sequence[int], rows: DataFrame | None = None) -> NDArray:
        rows = self.df if rows is None else rows
        return NDArray(rows.select(position(index, shape, self.order).alias("at"), "value"), tuple(shape), self.order)

    def at(self, *index: int) -> DataFrame:
        """``value`` at an index; negatives count from the end."""
        if len(index) != self.rank or any(not -n <= i < n for i, n in zip(index, self.shape, strict=True)):
            raise IndexError("no such place")
        where = sum(i % n * s for i, n, s in zip(index, self.shape, strides(self.shape, self.order), strict=True))
        return self.df.filter(F.col("at") == where).select("value")

    def front(self) -> DataFrame:
        return self.at(*[0] * self.rank)

    def back(self) -> DataFrame:
        return self.at(*[-1] * self.rank)

    def filled(self, value=0.0) -> NDArray:
        """Absent cells as a value."""
        places = self.df.sparkSession.range(self.size).select(F.col("id").alias("at"))
        return NDArray(places.join(self.df, "at", "left").select("at", F.coalesce("value", F.lit(value)).alias("value")), self.shape, self.order)

    # layout

    def reshape(self, *shape: int) -> NDArray:
        """Another shape over the same positions; one negative length is worked out."""
        if -1 in shape:
            rest = -math.prod(shape)
            shape = tuple(self.size // max(rest, 1) if n == -1 else n for n in shape)
        if math.prod(shape) != self.size:
            raise ValueError("the size must stay the same")
        return replace(self, shape=tuple(shape))

    def flatten(self) -> NDArray:
        return self.reshape(self.size)

    def with_order(self, order: str) -> NDArray:
        """The same positions read in an order; in the other one the axes are reversed."""
        return self if order == self.order else replace(self, shape=self.shape[::-1], order=order)

    def reordered(self, order: str) -> NDArray:
        """The same values at each index, laid out in an order."""
        return self if order == self.order else NDArray.of(self.df, self.shape, *self.index, order=order)

    def transpose(self, *axes: int) -> NDArray:
        """Axes in another sequence; reversed where none is given."""
        axes = axes or tuple(range(self.rank))[::-1]
        if sorted(axes) != list(range(self.rank)):
            raise ValueError("each axis once")
        return self._placed([self.index[a] for a in axes], [self.shape[a] for a in axes])

    def swapaxes(self, a: int, b: int) -> NDArray:
        axes = list(range(self.rank))
        axes[a], axes[b] = axes[b], axes[a]
        return self.transpose(*axes)

    def expand_dims(self, axis: int) -> NDArray:
        return self.reshape(*self.shape[:axis], 1, *self.shape[axis:])

    def squeeze(self) -> NDArray:
        return self.reshape(*[n for n in self.shape if n != 1])

    def flip(self, axes: int | Sequence[int] | None = None) -> NDArray:
        turned = self._axes(axes)
        return self._placed([n - 1 - i if k in turned else i for k, (i, n) in enumerate(zip(self.index, self.shape, strict=True))], self.shape)

    def roll(self, shift: int, axis: int) -> NDArray:
        index, k = self.index, self._axes(axis)[0]
        index[k] = F.pmod(index[k] + shift, F.lit(self.shape[k]))
        return self._placed(index, self.shape)

    def slice(self, *slices: Slice | None) -> NDArray:
        """Part of the array; an axis without a slice is taken whole."""
        slices = [*slices, *[None] * (self.rank - len(slices))]
        rows, index, shape = self.df, self.index, list(self.shape)
        for k, own in enumerate(slices):
            if own is not None:
                n, s = self.shape[k], own.resolved(self.shape[k])
                rows, shape[k] = rows.filter(own.keeps(self.index[k], n)), own.count(n)
                index[k] = F.call_function("div", self.index[k] - s.start, F.lit(s.step).cast("long"))
        return self._placed(index, shape, rows)

    def broadcast_to(self, *shape: int) -> NDArray:
        """Repeated along axes of length 1 and along new ones in front; as many cells as the result has."""
        own = (1,) * (len(shape) - self.rank) + self.shape
        if len(own) != len(shape) or any(n not in (1, m) for n, m in zip(own, shape, strict=True)):
            raise ValueError("the shape can't be broadcast")
        rows, index = self.df, [F.lit(0).cast("long")] * (len(shape) - self.rank) + self.index
        rows = rows.select("value", *[i.alias(f"i{k}") for k, i in enumerate(index)])
        for k, (n, m) in enumerate(zip(own, shape, strict=True)):
            if n != m:
                rows = rows.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))) if m else rows.limit(0)
        return NDArray.of(rows, shape, *[f"i{k}" for k in range(len(shape))], order=self.order)

    # values

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        base, own = self._source()
        return NDArray._from(base, f(own), self.shape, self.order)

    def _source(self) -> tuple[DataFrame, Column]:
        return (self.df, F.col("value")) if self.base is None else (self.base, self.expr)

    def fill(self, value) -> NDArray:
        """Every cell as a value, absent ones too."""
        return NDArray.from_function(self.df.sparkSession, lambda *_: F.lit(value), self.shape, self.order)

    def zip(self, other: NDArray | float, f: Callable[[Column, Column], Column]) -> NDArray:
        """f of two arrays cell by cell; axes, counted from the last, are equally long or one is 1 or absent.

        The side that is repeated is joined by its own position, worked out from the other's index, so it
        isn't multiplied. Result in the left side's order.
        """
        if not isinstance(other, NDArray):
            return self.map(lambda v: f(v, F.lit(other)))
        (base, a), (other_base, b) = self._source(), other._source()
        if base is other_base and (self.shape, self.order) == (other.shape, other.order):
            return NDArray._from(base, f(a, b), self.shape, self.order)
        rank = max(self.rank, other.rank)
        one, two = ((1,) * (rank - x.rank) + x.shape for x in (self, other))
        if any(n != m and 1 not in (n, m) for n, m in zip(one, two, strict=True)):
            raise ValueError("operands could not be broadcast together")
        shape = tuple(m if n == 1 else n for n, m in zip(one, two, strict=True))
        left, right = self, other
        if one != shape and two == shape:  # the left side is the repeated one
            return other.zip(self, lambda p, q: f(q, p)).reordered(self.order)
        if one != shape:
            left = left.broadcast_to(*shape)
        index = [F.lit(0).cast("long") if n == 1 else i for i, n in zip(left.index, two, strict=True)]
        rows = left.df.withColumn("_at", position(index, two, right.order))
        joined = rows.join(right.df.select(F.col("at").alias("_at"), F.col("value").alias("_v")), "_at")
        return NDArray(joined.select("at", f(F.col("value"), F.col("_v")).alias("value")), left.shape, left.order)

    def __add__(self, other):
        return self.zip(other, lambda a, b: a + b)

    __radd__ = __add__

    def __sub__(self, other):
        return self.zip(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self.zip(other, lambda a, b: b - a)

    def __mul__(self, other):
        return self.zip(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        from ..functions.numeric import divide

        return self.zip(other, divide)

    # reductions

    def _left(self, axes: int | Sequence[int] | None, keep: bool) -> tuple[Column, tuple[int, ...], list[int]]:
        gone = self._axes(axes)
        rest = [k for k in range(self.rank) if k not in gone]
        at = position([self.index[k] for k in rest], [self.shape[k] for k in rest], self.order)
        shape = tuple(1 if k in gone else n for k, n in enumerate(self.shape) if keep or k not in gone)
        return at, shape, gone

    def reduce(self, f: Callable[[Column], Column], axes: int | Sequence[int] | None = None, keep: bool = False) -> NDArray:
        """An aggregate over some axes, all where none is named; ``keep`` leaves them with length 1."""
        at, shape, _ = self._left(axes, keep)
        return NDArray(self.df.groupBy(at.alias("at")).agg(f(F.col("value")).alias("value")), shape, self.order)

    def arg_extreme(self, axes: int | Sequence[int] | None = None, largest: bool = True) -> NDArray:
        """Position, among the reduced axes, of the first extreme value."""
        at, shape, gone = self._left(axes, False)
        inner = position([self.index[k] for k in gone], [self.shape[k] for k in gone], self.order)
        value = -F.col("value") if largest else F.col("value")
        key = F.min(F.struct(value.alias("v"), inner.alias("p")))["p"]
        return NDArray(self.df.groupBy(at.alias("at")).agg(key.alias("value")), shape, self.order)

    def cumulative(self, f: Callable[[Column], Column], axis: int) -> NDArray:
        """A running aggregate along an axis."""
        at, _, gone = self._left(axis, False)
        rows = self.df.select("at", "value", at.alias("_rest"), self.index[gone[0]].alias("_along"))
        own = Window.partitionBy("_rest").orderBy("_along").rowsBetween(Window.unboundedPreceding, 0)
        return NDArray(rows.select("at", f(F.col("value")).over(own).alias("value")), self.shape, self.order)


def full(spark: SparkSession, shape: Sequence[int], value, order: str = "F") -> NDArray:
    return NDArray.from_function(spark, lambda *_: F.lit(value), shape, order)


def zeros(spark: SparkSession, shape: Sequence[int], order: str = "F") -> NDArray:
    return full(spark, shape, 0.0, order)


def ones(spark: SparkSession, shape: Sequence[int], order: str = "F") -> NDArray:
    return full(spark, shape, 1.0, order)


def empty(spark: SparkSession, shape: Sequence[int], order: str = "F") -> NDArray:
    return full(spark, shape, None, order).map(lambda v: v.cast("double"))


def diag(spark: SparkSession, value: float, shape: Sequence[int], order: str = "F") -> NDArray:
    """A value where all indices are equal, else 0."""
    on = lambda index: accumulate(lambda a, b: a & b, [i == index[0] for i in index], F.lit(True))
    return NDArray.from_function(spark, lambda *index: F.when(on(index), F.lit(float(value))).otherwise(0.0), shape, order)


def diagonal_matrix(values: NDArray, k: int = 0) -> NDArray:
    """A square array with a vector on its k-th diagonal, as long as the vector: what falls outside is lost."""
    n, i = values.size, values.index[0]
    kept = values.df.select((i - k).alias("r"), i.alias("c"), "value").filter((F.col("r") >= 0) & (F.col("r") < n))
    return NDArray.of(kept, (n, n), "r", "c", order=values.order).filled(0.0)


def meshgrid(vectors: Sequence[NDArray]) -> list[NDArray]:
    """For each vector the array over all of them that holds its value by its own axis."""
    shape = tuple(v.size for v in vectors)
    return [v.reshape(*[n if j == k else 1 for j, n in enumerate(shape)]).broadcast_to(*shape) for k, v in enumerate(vectors)]


def concatenate(arrays: Sequence[NDArray], axis: int = 0) -> NDArray:
    """Arrays one after the other along an axis, in the first one's order."""
    first = arrays[0]
    axis = first._axes(axis)[0]
    if any(a.rank != first.rank or a.shape[:axis] + a.shape[axis + 1 :] != first.shape[:axis] + first.shape[axis + 1 :] for a in arrays):
        raise ValueError("shapes differ")
    shape = tuple(sum(a.shape[axis] for a in arrays) if k == axis else n for k, n in enumerate(first.shape))
    ahead, parts = 0, []
    for a in arrays:
        index = a.index
        index[axis] = index[axis] + F.lit(ahead).cast("long")
        parts.append(a.df.select(position(index, shape, first.order).alias("at"), "value"))
        ahead += a.shape[axis]
    return NDArray(accumulate(DataFrame.unionByName, parts), shape, first.order)


def _at_least(a: NDArray, rank: int) -> NDArray:
    """Vectors are rows; a plane has one layer."""
    if a.rank == 1 and rank > 1:
        a = a.reshape(1, *a.shape)
    return a.reshape(*a.shape, *[1] * (rank - a.rank))


def vstack(arrays: Sequence[NDArray]) -> NDArray:
    return concatenate([_at_least(a, 2) for a in arrays], 0)


def hstack(arrays: Sequence[NDArray]) -> NDArray:
    return concatenate(arrays, 0 if arrays[0].rank == 1 else 1)


def dstack(arrays: Sequence[NDArray]) -> NDArray:
    return concatenate([_at_least(a, 3) for a in arrays], 2)


def from_table(df: DataFrame, keys: dict[str, Column], value: Column, order: str = "F") -> tuple[NDArray, list[DataFrame]]:
    """An aggregate of a table by key columns as an array with an axis for each key, and the axes' labels.

    ``value`` is an aggregate. Labels are ``label, index`` in rising order, null first. Rows are aggregated
    before they meet the labels; labels of any number are numbered by ranges, not in one task.
    """
    names = list(keys)
    cells = cut(df.select("*", *[c.alias(f"_axis_{k}") for k, c in keys.items()]).groupBy(*[f"_axis_{k}" for k in names]).agg(value.alias("value")))
    labels = [ranked(cells.select(F.col(f"_axis_{k}").alias("label")).distinct(), "label", name="index") for k in names]
    rows = cells
    for k, own in zip(names, labels, strict=True):
        rows = rows.join(own.select(F.col("label").alias(f"_label_{k}"), F.col("index").alias(f"_index_{k}")), F.col(f"_axis_{k}").eqNullSafe(F.col(f"_label_{k}")))
    return NDArray.of(rows, [x.count() for x in labels], *[f"_index_{k}" for k in names], order=order), labels
