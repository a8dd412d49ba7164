"""Indexing, masking and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranked
from .grid import Axis, Grid, Slice


def _flat(rows: DataFrame, *order: str) -> DataFrame:
    return ranked(rows, *order, name="_n").select(F.lit(0).cast("long").alias("row"), F.col("_n").alias("col"), "value")


def at(x: Grid, row: int, col: int | None = None) -> DataFrame:
    """One value, by flat position or place; an error out of bounds."""
    if col is None:
        row, col = divmod(row + x.size if row < 0 else row, x.cols)
    row, col = row + x.rows if row < 0 else row, col + x.cols if col < 0 else col
    if not (0 <= row < x.rows and 0 <= col < x.cols):
        raise IndexError("out of bounds")
    return x.df.filter((F.col("row") == row) & (F.col("col") == col)).select("value")


def front(x: Grid) -> DataFrame:
    return at(x, 0)


def back(x: Grid) -> DataFrame:
    return at(x, x.size - 1)


def item(x: Grid):
    """The only value of a grid of size 1."""
    if x.size != 1:
        raise ValueError("item needs a grid of size 1")
    return x.df.first()["value"]


def row(x: Grid, i: int) -> DataFrame:
    return x.df.filter(F.col("row") == i).select("col", "value")


def column(x: Grid, j: int) -> DataFrame:
    return x.df.filter(F.col("col") == j).select("row", "value")


def sliced(x: Grid, rows: Slice, cols: Slice) -> Grid:
    r, c = rows.resolved(x.rows), cols.resolved(x.cols)
    kept = x.df.filter(rows.keeps(F.col("row"), x.rows) & cols.keeps(F.col("col"), x.cols))
    places = [((F.col(n) - s.start) / s.step).cast("long").alias(n) for n, s in (("row", r), ("col", c))]
    return Grid(kept.select(*places, "value"), rows.count(x.rows), cols.count(x.cols))


def nonzero(x: Grid) -> DataFrame:
    return x.df.filter("value <> 0").select("row", "col")


def flatnonzero(x: Grid) -> DataFrame:
    """Flat positions of values other than zero, in order."""
    return _flat(x.df.filter("value <> 0").select(x.idx.alias("value")), "value")


argwhere = flatnonzero


def find(mask: Grid, n: int | None = None) -> DataFrame:
    """Flat positions where the mask holds, the first n of them."""
    rows = mask.df.filter(F.col("value").cast("boolean")).select(mask.idx.alias("value"))
    return _flat(rows.orderBy("value").limit(n) if n is not None else rows, "value")


def extract(mask: Grid, x: Grid) -> DataFrame:
    """Values where the mask holds, in flat order."""
    both = x.zip(mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return _flat(both.df.filter("value.m").select("row", "col", F.col("value.v").alias("value")), "row", "col")


get_by_mask = extract


def take(x: Grid, indices: DataFrame | list[int], axis: Axis = Axis.NONE) -> DataFrame:
    """Values at positions, in the order of the positions; along an axis whole columns or rows.

    indices: a list, or a table of ``pos, at`` of any size.
    """
    if isinstance(indices, list):
        n = {Axis.NONE: x.size, Axis.ROW: x.rows, Axis.COL: x.cols}[axis]
        indices = x.df.sparkSession.createDataFrame([(p, i + n if i < 0 else i) for p, i in enumerate(indices)], "pos long, at long")
    if axis is Axis.NONE:
        own = x.df.select(x.idx.alias("at"), "value")
        return own.join(indices, "at").select(F.lit(0).cast("long").alias("row"), F.col("pos").alias("col"), "value")
    c, k = axis.along[0], axis.keys[0]
    return x.df.join(indices, F.col(c) == F.col("at")).select(F.col(k), F.col("pos").alias("_p"), "value").withColumnRenamed("_p", c).select("row", "col", "value")


get_by_indices = take


def delete_indices(x: Grid, indices: list[int], axis: Axis = Axis.NONE) -> Grid:
    """The grid without flat positions, rows (Axis.ROW) or columns (Axis.COL)."""
    n = x.dim_size(axis)
    gone = sorted({i + n if i < 0 else i for i in indices})
    where = x.idx if axis is Axis.NONE else F.col(axis.along[0])
    before = F.size(F.filter(F.array(*[F.lit(i).cast("long") for i in gone]), lambda g: g < where)) if gone else F.lit(0)
    kept = (x.df.filter(~where.isin(gone)) if gone else x.df).withColumn("_before", before)
    before = F.col("_before")
    if axis is Axis.NONE:
        return Grid(kept.select(F.lit(0).cast("long").alias("row"), (x.idx - before).alias("col"), "value"), 1, x.size - len(gone))
    c = axis.along[0]
    moved = kept.select(*[(F.col(k) - before).cast("long").alias(k) if k == c else F.col(k) for k in ("row", "col")], "value")
    return Grid(moved, x.rows - len(gone) * (axis is Axis.ROW), x.cols - len(gone) * (axis is Axis.COL))


def insert(x: Grid, index: int, values: list[float]) -> Grid:
    """The flattened grid with values before a position."""
    n = len(values)
    moved = x.df.select(F.when(x.idx >= index, x.idx + n).otherwise(x.idx).alias("col"), "value")
    new = x.df.sparkSession.createDataFrame([(index + i, float(v)) for i, v in enumerate(values)], "col long, value double")
    return Grid(moved.unionByName(new).select(F.lit(0).cast("long").alias("row"), "col", "value"), 1, x.size + n)


def diagonal(x: Grid, offset: int = 0, axis: Axis = Axis.ROW) -> Grid:
    """Values of a diagonal as a flat grid; by rows an offset counts to the right."""
    side = F.col("col") - F.col("row") if axis is Axis.ROW else F.col("row") - F.col("col")
    kept = x.df.filter(side == offset).select(F.lit(0).cast("long").alias("row"), F.least("row", "col").alias("col"), "value")
    rows, cols = (x.rows, x.cols) if axis is Axis.ROW else (x.cols, x.rows)
    return Grid(kept, 1, max(0, min(rows, cols - offset) if offset >= 0 else min(rows + offset, cols)))


def fill_diagonal(x: Grid, value: float) -> Grid:
    return Grid(x.df.withColumn("value", F.when(F.col("row") == F.col("col"), F.lit(value)).otherwise(F.col("value"))), x.rows, x.cols)


def fill(x: Grid, value: float) -> Grid:
    return x.map(lambda _: F.lit(value))


def replace(x: Grid, old: float, new: float) -> Grid:
    return x.map(lambda v: F.when(v == old, F.lit(new)).otherwise(v))


def put(x: Grid, indices: list[int], value: float) -> Grid:
    own = [i + x.size if i < 0 else i for i in indices]
    return Grid(x.df.withColumn("value", F.when(x.idx.isin(own), F.lit(value)).otherwise(F.col("value"))), x.rows, x.cols)


def putmask(x: Grid, mask: Grid, value: float) -> Grid:
    return x.zip(mask, lambda v, m: F.when(m, F.lit(value)).otherwise(v))


def put_values(x: Grid, mask: Grid, values: Grid, cycle: bool = False) -> Grid:
    """The i-th place where the mask holds gets the i-th value; with cycle, values start over."""
    both = x.zip(mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    hits = ranked(both.df.filter("value.m").select("row", "col"), "row", "col", name="_n")
    hits = hits.withColumn("_n", F.col("_n") % values.size) if cycle else hits
    new = hits.join(values.df.select(values.idx.alias("_n"), F.col("value").alias("_new")), "_n").select("row", "col", "_new")
    return Grid(x.df.join(new, ["row", "col"], "left").select("row", "col", F.coalesce("_new", "value").alias("value")), x.rows, x.cols)


def place(x: Grid, mask: Grid, values: Grid) -> Grid:
    return put_values(x, mask, values, cycle=True)


def trim_zeros(x: Grid, sides: str = "fb") -> DataFrame:
    """A flat grid without zeros at its front (f) or back (b)."""
    span = x.df.filter("value <> 0").agg(F.min("col").alias("_a"), F.max("col").alias("_b"))
    kept: Column = F.col("_a").isNotNull()
    if "f" in sides:
        kept &= F.col("col") >= F.col("_a")
    if "b" in sides:
        kept &= F.col("col") <= F.col("_b")
    ahead = F.col("_a") if "f" in sides else F.lit(0)
    return x.df.crossJoin(F.broadcast(span)).filter(kept).select("row", (F.col("col") - ahead).alias("col"), "value")
