"""Arrays made from ranges, constants and local values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import NAN
from .grid import Grid


def _cells(spark: SparkSession, rows: int, cols: int):
    """Places of a shape, from one range."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / max(cols, 1)).cast("long").alias("row"), (F.col("id") % max(cols, 1)).alias("col"))


def _line(spark: SparkSession, n: int, value: Callable[[Column], Column]) -> Grid:
    return Grid(spark.range(n).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), value(F.col("id")).alias("value")), 1, n)


def from_function(spark: SparkSession, f: Callable[[Column, Column], Column], rows: int, cols: int) -> Grid:
    return Grid(_cells(spark, rows, cols).select("row", "col", f(F.col("row"), F.col("col")).alias("value")), rows, cols)


def full(spark: SparkSession, rows: int, cols: int, value) -> Grid:
    return from_function(spark, lambda r, c: F.lit(value), rows, cols)


def zeros(spark: SparkSession, rows: int, cols: int) -> Grid:
    return full(spark, rows, cols, 0.0)


def ones(spark: SparkSession, rows: int, cols: int) -> Grid:
    return full(spark, rows, cols, 1.0)


def nans(spark: SparkSession, rows: int, cols: int) -> Grid:
    return full(spark, rows, cols, NAN)


def empty(spark: SparkSession, rows: int, cols: int) -> Grid:
    """Cells without values (null)."""
    return from_function(spark, lambda r, c: F.lit(None).cast("double"), rows, cols)


def full_like(x: Grid, value) -> Grid:
    return x.map(lambda _: F.lit(value))


def zeros_like(x: Grid) -> Grid:
    return full_like(x, 0.0)


def ones_like(x: Grid) -> Grid:
    return full_like(x, 1.0)


def nans_like(x: Grid) -> Grid:
    return full_like(x, NAN)


def empty_like(x: Grid) -> Grid:
    return x.map(lambda _: F.lit(None).cast("double"))


def eye(spark: SparkSession, rows: int, cols: int | None = None, k: int = 0, compat: bool = False) -> Grid:
    """Ones on a diagonal; with compat, a negative k gives zeros."""
    cols = rows if cols is None else cols
    return from_function(spark, lambda r, c: F.when((c - r == k) & F.lit(not (compat and k < 0)), 1.0).otherwise(0.0), rows, cols)


def identity(spark: SparkSession, n: int, sparse: bool = False) -> Grid:
    """Sparse: the cells of the diagonal alone, for products, where absent cells are zeros."""
    if sparse:
        return Grid(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value")), n, n)
    return eye(spark, n)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1.0, integer: bool = False) -> Grid:
    """Evenly spaced values below stop. integer: start and step are cut to integers before use."""
    if stop is None:
        start, stop = 0.0, start
    n = max(0, math.ceil((stop - start) / step))
    if integer:
        return _line(spark, n, lambda i: F.lit(int(start)).cast("long") + i * int(step))
    return _line(spark, n, lambda i: start + i * F.lit(float(step)))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> Grid:
    if num < 1 or stop <= start:
        raise ValueError("linspace needs num >= 1 and stop above start")
    step = (stop - start) / max(num - 1 if endpoint else num, 1)
    last = F.lit(float(stop)) if endpoint and num > 1 else None
    value = lambda i: start + i * F.lit(step) if last is None else F.when(i == num - 1, last).otherwise(start + i * F.lit(step))
    return _line(spark, num, value)


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True, base: float = 10.0) -> Grid:
    return linspace(spark, start, stop, num, endpoint).map(lambda v: F.pow(F.lit(base), v))


def geomspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> Grid:
    parts = max(num - 1 if endpoint else num, 1)
    return _line(spark, num, lambda i: start * F.pow(F.lit(stop / start), i / parts))


def meshgrid(i: Grid, j: Grid) -> tuple[Grid, Grid]:
    """Two grids with a row for each value of j and a column for each of i.

    Every pair of the coordinates is wanted, so the ranges multiply; i is joined by its position.
    """
    spark = i.df.sparkSession
    cells = _cells(spark, j.size, i.size)
    x, y = (g.df.select((F.col("row") * g.cols + F.col("col")).alias("_at"), "value") for g in (i, j))
    first = cells.join(x, F.col("col") == F.col("_at")).select("row", "col", "value")
    second = cells.join(y, F.col("row") == F.col("_at")).select("row", "col", "value")
    return Grid(first, j.size, i.size), Grid(second, j.size, i.size)


def diagflat(x: Grid, k: int = 0) -> Grid:
    """The flattened values on the k-th diagonal of a square of zeros."""
    n = x.size + abs(k)
    cells = _cells(x.df.sparkSession, n, n)
    values = x.df.select((x.idx + max(-k, 0)).alias("_r"), (x.idx + max(k, 0)).alias("_c"), "value")
    joined = cells.join(values, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left")
    return Grid(joined.select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")), n, n)


def asarray(spark: SparkSession, values: list) -> Grid:
    return Grid.local(spark, values)


def fromiter(spark: SparkSession, values: Iterable[float]) -> Grid:
    return Grid.local(spark, list(values))


def triangle(x: Grid, k: int = 0, upper: bool = False) -> Grid:
    """The values at and below (or above) a diagonal, zeros elsewhere."""
    side = F.col("col") - F.col("row")
    kept = side >= k if upper else side <= k
    base, own = x._source()
    return Grid._from(base, F.when(kept, own).otherwise(0.0), x.rows, x.cols)


def tri(spark: SparkSession, n: int, k: int = 0, upper: bool = False) -> Grid:
    return triangle(ones(spark, n, n), k, upper)


def vander(x: Grid, n: int | None = None, increasing: bool = True) -> Grid:
    """Powers 0 to n - 1 of each value along a row."""
    n = x.size if n is None else n
    exponent = F.col("p") if increasing else n - 1 - F.col("p")
    rows = x.df.select(x.idx.alias("row"), "value", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
    return Grid(rows.select("row", F.col("p").cast("long").alias("col"), F.pow("value", exponent.cast("double")).alias("value")), x.size, n)


#: Windows for signals of m points (fixed coefficients), by name.
def bartlett(spark: SparkSession, m: int) -> Grid:
    return _line(spark, m, lambda i: 1 - F.abs(2.0 * i / (m - 1) - 1))


def blackman(spark: SparkSession, m: int) -> Grid:
    """Over linspace(0, m, m), each point divided by m."""
    turn = lambda i: i * (m / (m - 1)) / m * 2 * math.pi
    return _line(spark, m, lambda i: 0.42 - 0.5 * F.cos(turn(i)) + 0.08 * F.cos(2 * turn(i)))


def hamming(spark: SparkSession, m: int) -> Grid:
    return _line(spark, m, lambda i: 0.54 - 0.46 * F.cos(2 * math.pi * i / (m - 1)))


def hanning(spark: SparkSession, m: int) -> Grid:
    return _line(spark, m, lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / (m - 1)))


def bessel_i0(x: Column, most: int = 60) -> Column:
    """Modified Bessel function of order 0 by its power series, exact in double precision to |x| of 40."""
    quarter = x * x / 4
    term = lambda s, k: F.struct((s["sum"] + s["term"] * quarter / (k * k)).alias("sum"), (s["term"] * quarter / (k * k)).alias("term"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, term, lambda s: s["sum"])


def kaiser(spark: SparkSession, m: int, beta: float) -> Grid:
    half = (m - 1) / 2
    return _line(spark, m, lambda i: bessel_i0(beta * F.sqrt(1 - F.pow((i - half) / half, F.lit(2.0)))) / bessel_i0(F.lit(beta)))
