"""Shape and layout: places are rewritten, values stay."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from .creation import from_function
from .grid import Axis, Grid


def _r() -> Column:
    return F.col("row")


def _c() -> Column:
    return F.col("col")


def transpose(x: Grid) -> Grid:
    return x.place(_c(), _r(), x.cols, x.rows)


swapaxes = transpose


def flatten(x: Grid) -> Grid:
    return x.place(F.lit(0), x.idx, 1, x.size)


ravel = flatten


def reshape(x: Grid, rows: int, cols: int, order: str = "C") -> Grid:
    """Another shape of the same size; a negative length is worked out. Order F has rows run fastest."""
    if rows < 0 or cols < 0:
        rows, cols = (x.size // cols, cols) if rows < 0 else (rows, x.size // rows)
    if rows * cols != x.size:
        raise ValueError("the size must stay the same")
    if order == "C":
        return x.place(F.floor(x.idx / cols), x.idx % cols, rows, cols)
    at = _r() + _c() * x.rows
    return x.place(at % rows, F.floor(at / rows), rows, cols)


def resize(x: Grid, rows: int, cols: int) -> Grid:
    """Another shape with each value where it was; new places are 0."""
    cells = from_function(x.df.sparkSession, lambda r, c: F.lit(0.0), rows, cols).df.select("row", "col")
    return Grid(cells.join(x.df, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value")), rows, cols)


def flip(x: Grid, axis: Axis = Axis.NONE) -> Grid:
    """Along an axis; the whole grid in flat order."""
    row = x.rows - 1 - _r() if axis in (Axis.NONE, Axis.ROW) else _r()
    col = x.cols - 1 - _c() if axis in (Axis.NONE, Axis.COL) else _c()
    return x.place(row, col, x.rows, x.cols)


def fliplr(x: Grid) -> Grid:
    return flip(x, Axis.COL)


def flipud(x: Grid) -> Grid:
    return flip(x, Axis.ROW)


def rot90(x: Grid, k: int = 1) -> Grid:
    """Quarter turns counter-clockwise."""
    k %= 4
    if k == 1:
        return x.place(x.cols - 1 - _c(), _r(), x.cols, x.rows)
    if k == 2:
        return flip(x)
    if k == 3:
        return x.place(_c(), x.rows - 1 - _r(), x.cols, x.rows)
    return x


def vstack(grids: list[Grid]) -> Grid:
    if len({g.cols for g in grids}) > 1:
        raise ValueError("columns differ in number")
    ahead, parts = 0, []
    for g in grids:
        parts.append(g.df.select((_r() + ahead).alias("row"), "col", "value"))
        ahead += g.rows
    return Grid(fold(lambda a, b: a.unionByName(b), parts), ahead, grids[0].cols)


row_stack = vstack


def hstack(grids: list[Grid]) -> Grid:
    return transpose(vstack([transpose(g) for g in grids]))


column_stack = hstack


def stack(grids: list[Grid], axis: Axis) -> Grid:
    if axis is Axis.NONE:
        raise ValueError("stacking needs an axis")
    return vstack(grids) if axis is Axis.ROW else hstack(grids)


def concatenate(grids: list[Grid], axis: Axis = Axis.NONE) -> Grid:
    return hstack([flatten(g) for g in grids]) if axis is Axis.NONE else stack(grids, axis)


def append(x: Grid, values: Grid, axis: Axis = Axis.NONE) -> Grid:
    return concatenate([x, values], axis)


def rows_between(x: Grid, low: int, high: int) -> Grid:
    return Grid(x.df.filter((_r() >= low) & (_r() < high)).select((_r() - low).alias("row"), "col", "value"), high - low, x.cols)


def vsplit(x: Grid, cuts: list[int]) -> list[Grid]:
    """Parts between row cuts."""
    edges = [0, *sorted(cuts), x.rows]
    return [rows_between(x, a, b) for a, b in zip(edges, edges[1:], strict=False)]


def hsplit(x: Grid, cuts: list[int]) -> list[Grid]:
    return [transpose(g) for g in vsplit(transpose(x), cuts)]


def split(x: Grid, cuts: list[int], axis: Axis = Axis.ROW) -> list[Grid]:
    return vsplit(x, cuts) if axis is Axis.ROW else hsplit(x, cuts)


def pad(x: Grid, width: int, value: float) -> Grid:
    rows, cols = x.rows + 2 * width, x.cols + 2 * width
    border = from_function(x.df.sparkSession, lambda r, c: F.lit(float(value)), rows, cols).df
    inner = (_r() >= width) & (_r() < width + x.rows) & (_c() >= width) & (_c() < width + x.cols)
    moved = x.df.select((_r() + width).alias("row"), (_c() + width).alias("col"), "value")
    return Grid(border.filter(~inner).unionByName(moved), rows, cols)


def tile(x: Grid, down: int, across: int) -> Grid:
    """The whole grid repeated; each value makes down * across copies in its own task."""
    times = x.df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return Grid(times.select((_r() + F.col("_i") * x.rows).alias("row"), (_c() + F.col("_j") * x.cols).alias("col"), "value"), x.rows * down, x.cols * across)


repeat = tile


def swap_rows(x: Grid, i: int, j: int) -> Grid:
    return x.place(F.when(_r() == i, j).when(_r() == j, i).otherwise(_r()), _c(), x.rows, x.cols)


def swap_cols(x: Grid, i: int, j: int) -> Grid:
    return transpose(swap_rows(transpose(x), i, j))


def copy(x: Grid) -> Grid:
    """The grid itself: grids don't change."""
    return x


def diag(x: Grid, k: int = 0) -> Grid:
    """The k-th diagonal of a grid as a flat one; of a flat grid, the grid with that diagonal."""
    from .creation import diagflat

    if x.isflat():
        return diagflat(x, k)
    from .indexing import diagonal

    return diagonal(x, k)


def copyto(x: Grid, source: Grid | float, where: Grid | None = None) -> Grid:
    """The first grid with the other's values, under its broadcasting rules; with a mask only where that holds."""
    if where is None:
        return x.zip(source, lambda _, v: v)
    return x.zip(source, lambda v, w: F.struct(v.alias("v"), w.cast("double").alias("w"))).zip(where, lambda p, m: F.when(m, p["w"]).otherwise(p["v"]))


def swap(a: Grid, b: Grid) -> tuple[Grid, Grid]:
    """Both grids, each under the other's name."""
    return b, a


def resize_fast(x: Grid, rows: int, cols: int) -> Grid:
    """Another shape with new cells, all of them zero."""
    return from_function(x.df.sparkSession, lambda r, c: F.lit(0.0), rows, cols)


def alen(x: Grid) -> int:
    """Length of the first axis."""
    return x.rows
