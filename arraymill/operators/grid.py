"""The array: a lazy DataFrame of ``row, col, value`` with its shape beside it.

A one-dimensional array is a grid of one row. Shapes are known without a job wherever the operator
that makes a grid determines them. Axis.COL reduces across columns, giving a value for each row;
Axis.ROW reduces across rows, giving a value for each column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Axis(Enum):
    NONE = 0
    ROW = 1
    COL = 2

    @property
    def keys(self) -> list[str]:
        """Columns that a reduction along this axis groups by."""
        return {Axis.NONE: [], Axis.ROW: ["col"], Axis.COL: ["row"]}[self]

    @property
    def along(self) -> list[str]:
        """Columns that order the values along this axis."""
        return {Axis.NONE: ["row", "col"], Axis.ROW: ["row"], Axis.COL: ["col"]}[self]


@dataclass(frozen=True, eq=False)
class Grid:
    """``base`` and ``expr`` say where the values come from: grids made from the rows of one DataFrame, by
    ``columns`` or by ``map``, share it, and operators on them are expressions without a join."""

    df: DataFrame
    rows: int
    cols: int
    base: DataFrame | None = None
    expr: Column | None = None

    @staticmethod
    def columns(df: DataFrame, rows: int, cols: int, *values: Column) -> list[Grid]:
        """Grids of several values of the same ``row, col`` table."""
        return [Grid._from(df, v, rows, cols) for v in values]

    @staticmethod
    def _from(base: DataFrame, expr: Column, rows: int, cols: int) -> Grid:
        return Grid(base.select("row", "col", expr.alias("value")), rows, cols, base, expr)

    def _source(self) -> tuple[DataFrame, Column]:
        return (self.df, F.col("value")) if self.base is None else (self.base, self.expr)

    @staticmethod
    def of(df: DataFrame, rows: int | None = None, cols: int | None = None) -> Grid:
        """A grid over ``row, col, value``; a shape that isn't given is read from the data."""
        df = df.select(F.col("row").cast("long"), F.col("col").cast("long"), "value")
        if rows is None or cols is None:
            most = df.agg(F.max("row"), F.max("col")).first()
            rows, cols = (-1 if most[0] is None else most[0]) + 1, (-1 if most[1] is None else most[1]) + 1
        return Grid(df, rows, cols)

    @staticmethod
    def local(spark: SparkSession, values: list) -> Grid:
        """A grid from a list, or a list of equally long lists, on the driver."""
        table = values if values and isinstance(values[0], list | tuple) else [values]
        if len({len(r) for r in table}) > 1:
            raise ValueError("rows differ in length")
        rows = [(r, c, float(v)) for r, own in enumerate(table) for c, v in enumerate(own)]
        return Grid(spark.createDataFrame(rows, "row long, col long, value double"), len(table), len(table[0]))

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def idx(self) -> Column:
        """Row-major flat position."""
        return F.col("row") * self.cols + F.col("col")

    def isflat(self) -> bool:
        return 1 in self.shape

    def issquare(self) -> bool:
        return self.rows == self.cols

    def isscalar(self) -> bool:
        return self.size == 1

    def isempty(self) -> bool:
        return self.size == 0

    def dim_size(self, axis: Axis) -> int:
        return {Axis.NONE: self.size, Axis.ROW: self.rows, Axis.COL: self.cols}[axis]

    def nbytes(self) -> int:
        return self.size * {"double": 8, "bigint": 8, "float": 4, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1}.get(self.df.schema["value"].dataType.simpleString(), 8)

    def map(self, f: Callable[[Column], Column]) -> Grid:
        """The grid of f(value)."""
        base, own = self._source()
        return Grid._from(base, f(own), self.rows, self.cols)

    def place(self, row: Column, col: Column, rows: int, cols: int) -> Grid:
        """The grid with each value at another place."""
        return Grid(self.df.select(row.cast("long").alias("row"), col.cast("long").alias("col"), "value"), rows, cols)

    def zip(self, other: Grid | float | int, f: Callable[[Column, Column], Column]) -> Grid:
        """Element-wise f of two grids under the broadcasting rules.

        Shapes are equal, one side is a scalar, or one is flat and as long as the other's rows (one
        value for each row) or columns. A flat side is as small as one dimension of the other, so
        Spark chooses by its size whether to send it to every task.
        """
        if not isinstance(other, Grid):
            return self.map(lambda v: f(v, F.lit(other)))
        (base, a), (other_base, b) = self._source(), other._source()
        if base is other_base and self.shape == other.shape:
            return Grid._from(base, f(a, b), self.rows, self.cols)
        right = other.df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"))
        left, swap = self, False
        if self.shape == other.shape:
            joined = self.df.join(right, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")))
        else:
            if other.size > self.size:
                left, swap = other, True
                right = self.df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"))
            small = self if swap else other
            if small.isscalar():
                joined = left.df.crossJoin(F.broadcast(right.limit(1)))
            elif small.isflat() and small.size == left.rows:
                joined = left.df.join(right, F.col("row") == F.col("_r") + F.col("_c"))
            elif small.isflat() and small.size == left.cols:
                joined = left.df.join(right, F.col("col") == F.col("_r") + F.col("_c"))
            else:
                raise ValueError("operands could not be broadcast together")
        a, b = F.col("value"), F.col("_v")
        return Grid(joined.select("row", "col", (f(b, a) if swap else f(a, b)).alias("value")), left.rows, left.cols)

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

    def __rtruediv__(self, other):
        from ..functions.numeric import divide

        return self.zip(other, lambda a, b: divide(b, a))

    def __mod__(self, other):
        return self.zip(other, lambda a, b: a % b)

    def __rmod__(self, other):
        return self.zip(other, lambda a, b: b % a)

    def __neg__(self):
        return self.map(lambda a: -a)

    def __and__(self, other):
        return self.zip(other, lambda a, b: a.bitwiseAND(b))

    __rand__ = __and__

    def __or__(self, other):
        return self.zip(other, lambda a, b: a.bitwiseOR(b))

    __ror__ = __or__

    def __xor__(self, other):
        return self.zip(other, lambda a, b: a.bitwiseXOR(b))

    __rxor__ = __xor__

    def __invert__(self):
        return self.map(F.bitwise_not)

    def __lshift__(self, n: int):
        return self.map(lambda a: F.shiftleft(a, n))

    def __rshift__(self, n: int):
        return self.map(lambda a: F.shiftright(a, n))

    def __lt__(self, other):
        return self.zip(other, lambda a, b: a < b)

    def __le__(self, other):
        return self.zip(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self.zip(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self.zip(other, lambda a, b: a >= b)

    def __eq__(self, other):
        """Element by element; fractions are equal within a relative epsilon."""
        return self.equals(other)

    def __ne__(self, other):
        return self.equals(other).map(lambda a: ~a)

    __hash__ = object.__hash__

    def logical_and(self, other):
        """Whether both values are other than zero."""
        return self.zip(other, lambda a, b: (a.cast("double") != 0) & (b.cast("double") != 0))

    def logical_or(self, other):
        return self.zip(other, lambda a, b: (a.cast("double") != 0) | (b.cast("double") != 0))

    def logical_not(self):
        return self.map(lambda a: a.cast("double") == 0)

    def increment(self):
        return self.map(lambda a: a + 1)

    def decrement(self):
        return self.map(lambda a: a - 1)

    def equals(self, other):
        from ..functions.numeric import essentially_equal

        return self.zip(other, essentially_equal)


@dataclass(frozen=True)
class Slice:
    """start, stop and step; negatives count from the end, a falling slice is read in rising order."""

    start: int
    stop: int
    step: int = 1

    def resolved(self, size: int) -> Slice:
        start, stop, step = self.start, self.stop, self.step
        if step == 0:
            raise ValueError("a slice needs a step")
        start, stop = (x + size if x < 0 else x for x in (start, stop))
        if not 0 <= start <= size or not 0 <= stop <= size:
            raise ValueError("slice out of bounds")
        if start > stop:
            if step > 0:
                raise ValueError("a rising slice must not end before it starts")
            start, stop, step = stop, start, -step
        return Slice(start, stop, step)

    def keeps(self, position: Column, size: int) -> Column:
        own = self.resolved(size)
        return (position >= own.start) & (position < own.stop) & ((position - own.start) % own.step == 0)

    def to_indices(self, size: int) -> list[int]:
        """The positions in rising order; a slice is a bounded request, so they fit the driver."""
        own = self.resolved(size)
        return list(range(own.start, own.stop, own.step))

    def count(self, size: int) -> int:
        own = self.resolved(size)
        return -(-(own.stop - own.start) // own.step)
