"""Boundaries and neighbourhood filters of one- and two-dimensional grids.

Extremes and means deal every value to the places whose neighbourhood it lies in, the boundary rule having
turned places outside the grid into values inside, and aggregate by place. Order statistics and
convolutions work on tiles: a tile gets its own cells and a halo of half a kernel's width from the
tiles around it, so what is shuffled grows by the halo only and a window slides inside the task. No
operator needs the whole signal in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .layout import transpose


class Boundary(Enum):
    REFLECT = "reflect"
    CONSTANT = "constant"
    NEAREST = "nearest"
    MIRROR = "mirror"
    WRAP = "wrap"


def source(at: Column, n: int, rule: Boundary) -> Column:
    """Where the value at a place comes from; null for the constant."""
    inside = (at >= 0) & (at < n)
    if rule is Boundary.CONSTANT:
        return F.when(inside, at)
    if rule is Boundary.NEAREST:
        return F.greatest(F.least(at, F.lit(n - 1)), F.lit(0))
    if rule is Boundary.WRAP:
        return F.pmod(at, F.lit(n))
    if rule is Boundary.REFLECT:
        turn = F.pmod(at, F.lit(2 * n))
        return F.when(turn < n, turn).otherwise(2 * n - 1 - turn)
    period = max(2 * n - 2, 1)
    turn = F.pmod(at, F.lit(period))
    return F.when(turn < n, turn).otherwise(period - turn)


def add_boundary(x: Grid, width: int, rule: Boundary, constant: float = 0.0, two_dimensional: bool = True) -> Grid:
    """The grid with a border; a flat grid gets it along the columns only."""
    down = width if two_dimensional else 0
    rows, cols = x.rows + 2 * down, x.cols + 2 * width
    cells = x.df.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    r, c = source(F.col("row") - down, x.rows, rule), source(F.col("col") - width, x.cols, rule)
    own = x.df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    joined = cells.withColumn("_r", r.cast("long")).withColumn("_c", c.cast("long")).join(own, ["_r", "_c"], "left")
    return Grid(joined.select("row", "col", F.coalesce("value", F.lit(float(constant))).alias("value")), rows, cols)


def add_boundary_1d(x: Grid, rule: Boundary, kernel: int, constant: float = 0.0) -> Grid:
    _odd(kernel)
    return add_boundary(x, kernel // 2, rule, constant, two_dimensional=False)


def add_boundary_2d(x: Grid, rule: Boundary, kernel: int, constant: float = 0.0) -> Grid:
    _odd(kernel)
    return add_boundary(x, kernel // 2, rule, constant)


def trim_boundary(x: Grid, width: int, two_dimensional: bool = True) -> Grid:
    down = width if two_dimensional else 0
    kept = x.df.filter((F.col("row") >= down) & (F.col("row") < x.rows - down) & (F.col("col") >= width) & (F.col("col") < x.cols - width))
    return Grid(kept.select((F.col("row") - down).alias("row"), (F.col("col") - width).alias("col"), "value"), x.rows - 2 * down, x.cols - 2 * width)


def fill_corners(x: Grid, width: int, value: float | None = None) -> Grid:
    """Corners of a border set to a value, or to the nearest inner corner's value."""
    outer_r = (F.col("row") < width) | (F.col("row") >= x.rows - width)
    outer_c = (F.col("col") < width) | (F.col("col") >= x.cols - width)
    if value is not None:
        return Grid(x.df.withColumn("value", F.when(outer_r & outer_c, F.lit(value)).otherwise(F.col("value"))), x.rows, x.cols)
    near = lambda c, n: F.greatest(F.least(F.col(c), F.lit(n - 1 - width)), F.lit(width))
    cells = x.df.withColumn("_r", F.when(outer_r & outer_c, near("row", x.rows)).otherwise(F.col("row"))).withColumn("_c", F.when(outer_r & outer_c, near("col", x.cols)).otherwise(F.col("col"))).drop("value")
    own = x.df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return Grid(cells.join(own, ["_r", "_c"]).select("row", "col", "value"), x.rows, x.cols)


def _odd(size: int) -> None:
    if size < 1 or size % 2 == 0:
        raise ValueError("a kernel's size must be odd")


def neighbourhood(x: Grid, size: int, rule: Boundary, constant: float, two_dimensional: bool) -> DataFrame:
    """``row, col, dr, dc, value``: for each place all values of its neighbourhood, by offset."""
    _odd(size)
    half = size // 2
    down = half if two_dimensional else 0
    wide = add_boundary(x, half, rule, constant, two_dimensional)
    spread = wide.df.withColumn("dr", F.explode(F.sequence(F.lit(-down), F.lit(down)))).withColumn("dc", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    placed = spread.select((F.col("row") - down - F.col("dr")).alias("row"), (F.col("col") - half - F.col("dc")).alias("col"), "dr", "dc", "value")
    return placed.filter((F.col("row") >= 0) & (F.col("row") < x.rows) & (F.col("col") >= 0) & (F.col("col") < x.cols))


def apply(x: Grid, size: int, f: Callable[[Column], Column], rule: Boundary = Boundary.REFLECT, constant: float = 0.0, two_dimensional: bool | None = None) -> Grid:
    """Any aggregate over neighbourhoods; two-dimensional unless the grid is flat."""
    deep = not x.isflat() if two_dimensional is None else two_dimensional
    near = neighbourhood(x, size, rule, constant, deep)
    return Grid(near.groupBy("row", "col").agg(f(F.col("value")).alias("value")), x.rows, x.cols)


def separable(x: Grid, run: Callable[[Grid], Grid], two_dimensional: bool | None = None) -> Grid:
    """A filter that works along the columns, and in two dimensions then along the rows: each value is
    dealt to 2 * size places, not to the square of the size."""
    deep = not x.isflat() if two_dimensional is None else two_dimensional
    out = run(x)
    return transpose(run(transpose(out))) if deep else out


#: Places along each axis of a tile of a plane, and along the only axis of a tile of lines.
TILE, LINE_TILE = 256, 16_384
#: numpy's names of the boundary rules.
PADS = {Boundary.REFLECT: "symmetric", Boundary.CONSTANT: "constant", Boundary.NEAREST: "edge", Boundary.MIRROR: "reflect", Boundary.WRAP: "wrap"}


def _places(at: str, n: int, tile: int, half: int, wrap: bool) -> Column:
    """The tiles that a place belongs to or lies in the halo of, with its position as the tile sees it."""
    last = -(-n // tile) - 1
    c = F.col(at)

    def seen(p: Column) -> Column:
        tiles = [F.call_function("div", x, F.lit(tile).cast("long")) for x in (F.greatest(p - half, F.lit(0)), F.least(p + half, F.lit(n - 1)))]
        return F.transform(F.sequence(*tiles), lambda t: F.struct(t.alias("tile"), p.alias("p")))

    own = seen(c)
    if not wrap or not last:
        return own
    # beyond an end the other end follows
    none = F.filter(own, lambda _: F.lit(False))
    start = F.when(c < half, F.transform(F.array(F.lit(last).cast("long")), lambda t: F.struct(t.alias("tile"), (c + n).alias("p")))).otherwise(none)
    end = F.when(c >= n - half, F.transform(F.array(F.lit(0).cast("long")), lambda t: F.struct(t.alias("tile"), (c - n).alias("p")))).otherwise(none)
    return F.concat(own, start, end)


def sliding(x: Grid, size: int, f: Callable[[np.ndarray], np.ndarray], rule: Boundary = Boundary.REFLECT, constant: float = 0.0, two_dimensional: bool | None = None, tile: int | None = None) -> Grid:
    """f over the windows of every place, a window's values as a row; absent cells of the grid are zeros."""
    _odd(size)
    deep = not x.isflat() if two_dimensional is None else two_dimensional
    half, rows, cols = size // 2, x.rows, x.cols
    down = half if deep else 0
    # a halo reaches no further than the next tile
    height = max(tile or TILE, down + 1)
    width = max(tile or (TILE if deep or rows > 1 else LINE_TILE), half + 1)
    wrap, mode = rule is Boundary.WRAP, PADS[rule]
    around = {"constant_values": constant} if rule is Boundary.CONSTANT else {}
    placed = x.df.withColumn("_r", F.explode(_places("row", rows, height, down, wrap))).withColumn("_c", F.explode(_places("col", cols, width, half, wrap)))
    dealt = placed.select(F.col("_r.tile").alias("tr"), F.col("_c.tile").alias("tc"), F.col("_r.p").alias("r"), F.col("_c.p").alias("c"), F.col("value").cast("double").alias("value"))

    def span(at: int, length: int, n: int, reach: int) -> tuple[int, int, int, int]:
        """A tile's first and last place, and those of its values."""
        first, last = at * length, min((at + 1) * length, n)
        whole = wrap and n > length
        return first, last, first - reach if whole else max(first - reach, 0), last + reach if whole else min(last + reach, n)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        (r0, r1, top, bottom), (c0, c1, left, right) = span(int(key[0]), height, rows, down), span(int(key[1]), width, cols, half)
        cells = np.zeros((bottom - top, right - left))
        cells[group["r"].to_numpy() - top, group["c"].to_numpy() - left] = group["value"].to_numpy(float, na_value=np.nan)
        cells = np.pad(cells, ((top - r0 + down, r1 + down - bottom), (left - c0 + half, c1 + half - right)), mode, **around)
        out = np.empty((r1 - r0, c1 - c0))
        for i in range(len(out)):
            near = np.lib.stride_tricks.sliding_window_view(cells[i : i + 2 * down + 1], size, axis=1)
            out[i] = f(near.transpose(1, 0, 2).reshape(c1 - c0, -1))
        r, c = np.indices(out.shape)
        return pd.DataFrame({"row": r.ravel() + r0, "col": c.ravel() + c0, "value": out.ravel()})

    return Grid(dealt.groupBy("tr", "tc").applyInPandas(run, "row long, col long, value double"), rows, cols)


def ranked_value(share: float | None = None, rank: int | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The value of a rank, or of a share of the ranks between two of them, of each row; NaN is the largest."""

    def run(windows: np.ndarray) -> np.ndarray:
        exact = (windows.shape[1] - 1) * share if rank is None else rank
        low, high = math.floor(exact), math.ceil(exact)
        ordered = np.partition(windows, sorted({low, high}), axis=1)
        return ordered[:, low] if low == high else ordered[:, low] * (high - exact) + ordered[:, high] * (exact - low)

    return run


def uniform_filter(x: Grid, size: int, two_dimensional: bool | None = None, **kw) -> Grid:
    return separable(x, lambda g: apply(g, size, F.avg, two_dimensional=False, **kw), two_dimensional)


def maximum_filter(x: Grid, size: int, two_dimensional: bool | None = None, **kw) -> Grid:
    return separable(x, lambda g: apply(g, size, F.max, two_dimensional=False, **kw), two_dimensional)


def minimum_filter(x: Grid, size: int, two_dimensional: bool | None = None, **kw) -> Grid:
    return separable(x, lambda g: apply(g, size, F.min, two_dimensional=False, **kw), two_dimensional)


def median_filter(x: Grid, size: int, **kw) -> Grid:
    return sliding(x, size, ranked_value(0.5), **kw)


def percentile_filter(x: Grid, size: int, p: float, **kw) -> Grid:
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies in 0 to 100")
    return sliding(x, size, ranked_value(p / 100), **kw)


def rank_filter(x: Grid, size: int, rank: int, **kw) -> Grid:
    """The value of a rank, from 0, among the neighbourhood."""
    deep = kw.get("two_dimensional")
    if not 0 <= rank < size ** (1 + (not x.isflat() if deep is None else deep)):
        raise ValueError("a rank is below the number of values")
    return sliding(x, size, ranked_value(rank=rank), **kw)


def complementary_median_filter(x: Grid, size: int, **kw) -> Grid:
    return x.zip(median_filter(x, size, **kw), lambda a, b: a - b)


def convolve(x: Grid, weights: list, rule: Boundary = Boundary.REFLECT, constant: float = 0.0) -> Grid:
    """Convolution (the kernel is turned about) with a list, or a list of lists, of weights."""
    table = weights if isinstance(weights[0], list | tuple) else [weights]
    deep = len(table) > 1
    size = len(table[0])
    if deep and len(table) != size:
        raise ValueError("a kernel must be square")
    turned = np.array([w for own in table for w in own], float)[::-1]
    return sliding(x, size, lambda windows: windows @ turned, rule, constant, two_dimensional=deep)


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Normalised weights over an odd number of points, eight sigmas wide and five at least."""
    n = max(math.ceil(8 * sigma), 5)
    n += n % 2 == 0
    at = np.arange(n) - n // 2
    w = np.exp(-(at**2) / (2 * sigma**2))
    return w / w.sum()


def gaussian_filter(x: Grid, sigma: float, rule: Boundary = Boundary.REFLECT, constant: float = 0.0) -> Grid:
    own = gaussian_kernel(sigma).tolist()
    return separable(x, lambda g: convolve(g, own, rule, constant))


def laplace(x: Grid, rule: Boundary = Boundary.REFLECT, constant: float = 0.0) -> Grid:
    return convolve(x, [[0, 1, 0], [1, -4, 1], [0, 1, 0]], rule, constant)
