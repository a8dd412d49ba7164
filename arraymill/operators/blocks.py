"""Matrices in tiles: products, powers, Gram and covariance matrices without a row for each pair of cells.

A tile is a row of ``brow, bcol, data`` with its cells as bytes, row by row; tiles at the lower and right
border are as small as the matrix leaves them. A product deals the tiles of both sides to squares of the
result, which take them in order of their inner place and add up as they go, so only tiles of the factors are
shuffled and none of the result. A Gram matrix joins the tiles of equal inner place, adds up what a task has
for a tile of the result as long as it has room, and sums the rest after a shuffle of tiles. All cells take
part, so zeros that meet infinite values or NaN give NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import Tables, cut
from .grid import Grid

SIDE = 128
#: Bytes of partial results that a task holds before it passes them on.
HELD = 64 << 20
#: Bytes of a square of a product's result; the larger, the fewer times tiles of the factors are dealt out.
SQUARE = 512 << 20
#: Bytes that a pass of a product, or of a triangle's solution, deals out, where that keeps all cores busy.
DEALT = 8 << 30
SCHEMA = "brow long, bcol long, data binary"


def _packed(tile: np.ndarray) -> bytes:
    return np.ascontiguousarray(tile, np.float64).tobytes()


def _batch(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(tiles)
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([_packed(t) for t in tiles.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["brow", "bcol", "data"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that a batch's tiles aren't copied all at once."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)


def _added(parts: DataFrame) -> DataFrame:
    """Tiles of one place added up. A task reads them in order of place and holds one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for brow, bcol, data in _rows(batches):
            if (brow, bcol) != place:
                if place is not None:
                    yield _batch({place: total})
                place, total = (brow, bcol), np.zeros(len(data) // 8)
            total += np.frombuffer(data)
        if place is not None:
            yield _batch({place: total})

    return parts.repartition("brow", "bcol").sortWithinPartitions("brow", "bcol").mapInArrow(run, SCHEMA)


@dataclass(frozen=True, eq=False)
class BlockMatrix:
    """``made`` is what the tiles come from, with the step that makes them, so that the next one can run in the same worker."""

    df: DataFrame
    rows: int
    cols: int
    side: int = SIDE
    made: tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]] | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    # to and from other forms

    @staticmethod
    def from_grid(x: Grid, side: int = SIDE) -> BlockMatrix:
        """Tiles of a grid, absent cells as zeros; each cell is shuffled once."""
        rows, cols = x.shape
        at = lambda c: F.call_function("div", F.col(c), F.lit(side).cast("long"))
        cells = x.df.select(at("row").alias("brow"), at("col").alias("bcol"), (F.col("row") % side).alias("r"), (F.col("col") % side).alias("c"), F.col("value").cast("double").alias("value"))

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            tile = np.zeros((min(side, rows - int(key[0]) * side), min(side, cols - int(key[1]) * side)))
            own = group.dropna(subset=["r"])
            tile[own["r"].to_numpy(np.int64), own["c"].to_numpy(np.int64)] = own["value"].to_numpy(float, na_value=np.nan)
            return pd.DataFrame({"brow": [key[0]], "bcol": [key[1]], "data": [_packed(tile)]})

        # a row for each tile, so that those without cells are there
        down, across = -(-rows // side), -(-cols // side)
        every = x.df.sparkSession.range(down * across).select(F.call_function("div", F.col("id"), F.lit(max(across, 1)).cast("long")).alias("brow"), (F.col("id") % max(across, 1)).alias("bcol"))
        return BlockMatrix(cells.unionByName(every, allowMissingColumns=True).groupBy("brow", "bcol").applyInPandas(run, SCHEMA), x.rows, x.cols, side)

    @staticmethod
    def from_vectors(df: DataFrame, row: Column, vector: Column, rows: int, cols: int, side: int = SIDE) -> BlockMatrix:
        """Tiles of a table with a row's position and its cells as an array; rows must all be there."""
        own = df.select(F.call_function("div", row, F.lit(side).cast("long")).alias("strip"), (row % side).alias("r"), vector.cast("array<double>").alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, filled, at = None, 0, None

            def tiles() -> Iterator[pa.RecordBatch]:
                if filled != len(held):
                    raise ValueError("a row is missing or there twice")
                for n, start in enumerate(range(0, cols, side)):
                    yield _batch({(at, n): held[:, start : start + side]})

            for batch in batches:
                strips, places = (batch.column(n).to_numpy() for n in ("strip", "r"))
                cells = batch.column("v")
                if cells.null_count or (pa.compute.list_value_length(cells).to_numpy() != cols).any():
                    raise ValueError("a row has another number of cells")
                cells = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, cols)
                bounds = [0, *(np.flatnonzero(np.diff(strips)) + 1), len(strips)]
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    if low == high:
                        continue
                    if strips[low] != at:
                        if at is not None:
                            yield from tiles()
                        at, filled = int(strips[low]), 0
                        held = np.empty((min(side, rows - at * side), cols))
                    if filled + high - low > len(held) or (places[low:high] != np.arange(filled, filled + high - low)).any():
                        raise ValueError("a row is missing or there twice")
                    held[filled : filled + high - low] = cells[low:high]
                    filled += high - low
            if at is not None:
                yield from tiles()

        dealt = own.repartition("strip").sortWithinPartitions("strip", "r")
        return BlockMatrix(dealt.mapInArrow(run, SCHEMA), rows, cols, side)

    def to_grid(self) -> Grid:
        side, width = self.side, self.cols
        source, make = self.made or (self.df, lambda batches: batches)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, bcol, data in _rows(make(batches)):
                tile = np.frombuffer(data).reshape(-1, min(side, width - bcol * side))
                r, c = np.indices(tile.shape)
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel() + brow * side), pa.array(c.ravel() + bcol * side), pa.array(tile.ravel())], ["row", "col", "value"])

        return Grid(source.mapInArrow(run, "row long, col long, value double"), self.rows, self.cols)

    @staticmethod
    def identity(spark: SparkSession, n: int, side: int = SIDE) -> BlockMatrix:
        cells = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
        return BlockMatrix.from_grid(Grid(cells, n, n), side)

    @staticmethod
    def diagonal(values: DataFrame, n: int, side: int = SIDE) -> BlockMatrix:
        """``at, value`` on the diagonal of a square matrix: its tiles there, the others stay absent and are zeros to a product."""
        strip = F.call_function("div", F.col("at"), F.lit(side).cast("long")).alias("brow")

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            tile = np.zeros((min(side, n - int(key[0]) * side),) * 2)
            own = group["at"].to_numpy(np.int64) % side
            tile[own, own] = group["value"].to_numpy(float)
            return pd.DataFrame({"brow": [key[0]], "bcol": [key[0]], "data": [_packed(tile)]})

        return BlockMatrix(values.select(strip, "at", "value").groupBy("brow").applyInPandas(run, SCHEMA), n, n, side)

    # operators

    def _each(self, f: Callable[[np.ndarray], np.ndarray], flipped: bool = False) -> DataFrame:
        side, height, width = self.side, self.rows, self.cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, bcol, data in _rows(batches):
                tile = np.frombuffer(data).reshape(min(side, height - brow * side), min(side, width - bcol * side))
                yield _batch({(bcol, brow) if flipped else (brow, bcol): f(tile)})

        return self.df.select("brow", "bcol", "data").mapInArrow(run, SCHEMA)

    def transpose(self) -> BlockMatrix:
        return BlockMatrix(self._each(lambda t: t.T, True), self.cols, self.rows, self.side)

    def map(self, f: Callable[[np.ndarray], np.ndarray]) -> BlockMatrix:
        """f of each tile's cells."""
        return BlockMatrix(self._each(f), self.rows, self.cols, self.side)

    def _summed(self, pairs: DataFrame, height: int, width: int, product: Callable[[bytes, bytes, tuple[int, int]], np.ndarray]) -> DataFrame:
        """Products of ``brow, bcol, a, b`` summed by tile, in the task and after a shuffle."""
        side = self.side

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            size = 0
            for brow, bcol, a, b in _rows(batches):
                extent = min(side, height - brow * side), min(side, width - bcol * side)
                tile = product(a, b, extent)
                if (brow, bcol) in held:
                    held[brow, bcol] += tile
                else:
                    held[brow, bcol] = tile
                    size += tile.nbytes
                if size > HELD:
                    yield from (_batch({k: t}) for k, t in held.items())
                    held, size = {}, 0
            yield from (_batch({k: t}) for k, t in held.items())

        return _added(pairs.select("brow", "bcol", "a", "b").mapInArrow(multiply, SCHEMA))

    def multiply(self, other: BlockMatrix, plus: DataFrame | None = None, lower: bool = False) -> BlockMatrix:
        """The product, added to the tiles ``plus`` if there are any; with ``lower`` only tiles at and below the diagonal."""
        if self.cols != other.rows or self.side != other.side:
            raise ValueError("inner dimensions or tiles differ")
        down, across, inner = (max(1, -(-n // self.side)) for n in (self.rows, other.cols, self.cols))
        dealt, run = _dealt(self.df, other.df, self.side, (self.rows, other.cols), (0, down), (0, across), inner, plus, lower=lower)
        return BlockMatrix(dealt.mapInArrow(run, SCHEMA), self.rows, other.cols, self.side, (dealt, run))

    def gram(self) -> BlockMatrix:
        """The product of the transpose with the matrix: tiles of a strip of rows meet, nothing is transposed."""
        if self.cols <= self.side:
            return self._narrow_gram()
        left = self.df.select(F.col("brow").alias("_k"), F.col("bcol").alias("brow"), F.col("data").alias("a"))
        right = self.df.select(F.col("brow").alias("_k"), "bcol", F.col("data").alias("b"))

        def product(a: bytes, b: bytes, extent: tuple[int, int]) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                return np.frombuffer(a).reshape(-1, extent[0]).T @ np.frombuffer(b).reshape(-1, extent[1])

        return BlockMatrix(self._summed(left.join(right, "_k"), self.cols, self.cols, product), self.cols, self.cols, self.side)

    def _narrow_gram(self) -> BlockMatrix:
        """Where a row of tiles is a single one, it meets nothing but itself, so nothing is joined."""
        width = self.cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for (data,) in _rows(batches):
                tile = np.frombuffer(data).reshape(-1, width)
                with np.errstate(invalid="ignore"):
                    total = tile.T @ tile if total is None else total + tile.T @ tile
            if total is not None:
                yield _batch({(0, 0): total})

        return BlockMatrix(_added(self.df.select("data").mapInArrow(run, SCHEMA)), width, width, self.side)

    def column_sums(self) -> DataFrame:
        """``bcol, data``: a vector of sums for each column of tiles."""
        height, width, side = self.rows, self.cols, self.side

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for brow, bcol, data in _rows(batches):
                own = np.frombuffer(data).reshape(min(side, height - brow * side), min(side, width - bcol * side)).sum(axis=0)
                held[0, bcol] = held[0, bcol] + own if (0, bcol) in held else own
            yield _batch(held)

        return _added(self.df.select("brow", "bcol", "data").mapInArrow(run, SCHEMA)).drop("brow")

    def covariance(self, bias: bool = False) -> BlockMatrix:
        """Of the columns as variables over the rows: columns are centred before they are multiplied."""
        height, width, side, n = self.rows, self.cols, self.side, self.rows
        joined = self.df.join(self.column_sums().withColumnRenamed("data", "sums"), "bcol").select("brow", "bcol", "data", "sums")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, bcol, data, sums in _rows(batches):
                tile = np.frombuffer(data).reshape(min(side, height - brow * side), min(side, width - bcol * side))
                yield _batch({(brow, bcol): tile - np.frombuffer(sums) / n})

        # both sides of the product read the centred tiles
        centred = BlockMatrix(cut(joined.mapInArrow(run, SCHEMA)), height, width, side)
        return centred.gram().map(lambda t: t / (n if bias else n - 1))


def _finite(tile: np.ndarray) -> bool:
    return bool(np.isfinite(tile).all())


def _ranged(low: int | Column, high: int | Column) -> Column:
    """A row for each whole number from one to the other."""
    low, high = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (low, high))
    return F.explode(F.sequence(low, high))


def grouped(spark: SparkSession, side: int, down: int, across: int, single: bool) -> int:
    """The side, in tiles, of a square of a product's result.

    Each tile is dealt once for every square of its row or column, so squares are as few as keep all cores busy. A square
    holds its sums; of a single inner tile there are none, and only the left side is held.
    """
    most = HELD // (8 * side * side) if single else math.isqrt(SQUARE // (8 * side * side))
    tasks = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(1, min(most, round(math.sqrt(down * across / tasks))))


def kept_product(tables: Tables, left: DataFrame, right: DataFrame, side: int, shape: tuple[int, int], rows: tuple[int, int], cols: tuple[int, int], inner: int, plus: DataFrame | None = None, minus: bool = False, lower: bool = False) -> list[str]:
    """``product`` as tables, in as many passes as keep what is dealt at a time, and then deleted, near ``DEALT``."""
    spark, down, across = left.sparkSession, rows[1] - rows[0], cols[1] - cols[0]
    cores = spark.sparkContext.defaultParallelism
    # a square takes its tiles of both sides
    group = max(1, min(grouped(spark, side, down, across, False), DEALT // (16 * side * side * inner * cores)))
    count, at_once = -(-down // group) * -(-across // group), max(1, DEALT // (16 * side * side * inner * group * cores)) * cores
    return [tables.write(product(left, right, side, shape, rows, cols, inner, plus, minus, lower, group, (first, min(first + at_once, count)))) for first in range(0, count, at_once)]


def _dealt(left: DataFrame, right: DataFrame, side: int, shape: tuple[int, int], rows: tuple[int, int], cols: tuple[int, int], inner: int, plus: DataFrame | None = None, minus: bool = False, lower: bool = False, group: int | None = None, squares: tuple[int, int] | None = None) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """What makes tiles of the left side times those of the right, in ranges of tile rows and columns of a matrix of the shape: both sides dealt out, and the step.

    Sums begin with the tiles of ``plus``; with ``minus`` products are taken off. Absent tiles are zeros, and a tile that
    neither side nor ``plus`` reaches stays absent. With ``lower`` only tiles at and below the diagonal are made. A
    tile of zeros takes no multiplication unless it meets values that aren't finite. ``group`` is the side of a square of
    the result, in tiles; of all ``squares``, row by row, a range may be made.
    """
    (height, width), single = shape, inner == 1 and plus is None
    group = group or grouped(left.sparkSession, side, rows[1] - rows[0], cols[1] - cols[0], single)
    strips, stacks = -(-(rows[1] - rows[0]) // group), -(-(cols[1] - cols[0]) // group)
    first, last = squares or (0, strips * stacks)
    # files of tiles in other strips aren't read
    reached = (F.col("brow") >= rows[0] + first // stacks * group) & (F.col("brow") < rows[0] + (-(-last // stacks)) * group)
    left, plus = left.filter(reached), None if plus is None else plus.filter(reached)
    at = lambda c, start: F.call_function("div", F.col(c) - start, F.lit(group).cast("long"))
    i, j = at("brow", rows[0]), at("bcol", cols[0])
    here = lambda df: df.filter((F.col("_i") * stacks + F.col("_j") >= first) & (F.col("_i") * stacks + F.col("_j") < last))
    sides = [
        left.select(i.alias("_i"), _ranged(0, i if lower else stacks - 1).alias("_j"), F.col("bcol").alias("_k"), F.lit(0).alias("_side"), F.col("brow").alias("_at"), F.lit(0).cast("long").alias("_to"), "data"),
        right.select(_ranged(j if lower else 0, strips - 1).alias("_i"), j.alias("_j"), F.col("brow").alias("_k"), F.lit(1).alias("_side"), F.col("bcol").alias("_at"), F.lit(0).cast("long").alias("_to"), "data"),
    ]
    if plus is not None:
        sides.append(plus.select(i.alias("_i"), j.alias("_j"), F.lit(-1).cast("long").alias("_k"), F.lit(-1).alias("_side"), F.col("brow").alias("_at"), F.col("bcol").alias("_to"), "data"))
    dealt = here(sides[0])
    for side_ in sides[1:]:
        dealt = dealt.unionByName(here(side_))
    square = (F.col("_i") * stacks + F.col("_j") - first).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k, column, sums = None, None, {}, {}
        for i, j, inside, which, place, to, data in _rows(batches):
            if (i, j) != own:
                while sums:
                    key, total = sums.popitem()
                    yield _batch({key: total})
                own, k, column = (i, j), None, {}
            if which == -1:
                sums[place, to] = np.frombuffer(data).reshape(min(side, height - place * side), -1).copy()
                continue
            if inside != k:
                k, column = inside, {}
            if which == 0:
                tile = np.frombuffer(data).reshape(min(side, height - place * side), -1)
                column[place] = tile, bool(tile.any())
                continue
            tile = np.frombuffer(data).reshape(-1, min(side, width - place * side))
            some = bool(tile.any())
            for brow, (a, filled) in column.items():
                if lower and brow < place:
                    continue
                if (not filled and _finite(tile)) or (not some and _finite(a)):
                    made = None
                else:
                    with np.errstate(invalid="ignore"):
                        made = a @ tile
                    made = np.negative(made, out=made) if minus else made
                if made is not None and (brow, place) in sums:
                    sums[brow, place] += made
                elif (brow, place) not in sums:
                    sums[brow, place] = np.zeros((len(a), tile.shape[1])) if made is None else made
                if single:
                    yield _batch({(brow, place): sums.pop((brow, place))})
        while sums:
            key, total = sums.popitem()
            yield _batch({key: total})

    # a square is a partition of its own, since its work is far more than its bytes say
    dealt = dealt.repartitionById(min(last - first, 4096), square).sortWithinPartitions("_i", "_j", "_k", "_side", "_at")
    return dealt.select("_i", "_j", "_k", "_side", "_at", "_to", "data"), run


def product(left: DataFrame, right: DataFrame, *args, **kwargs) -> DataFrame:
    """Tiles of a product, as ``_dealt`` describes them."""
    dealt, run = _dealt(left, right, *args, **kwargs)
    return dealt.mapInArrow(run, SCHEMA)


def chain(matrices: Sequence[BlockMatrix]) -> BlockMatrix:
    """The product of several matrices in the sequence of products that needs the fewest multiplications."""
    n = len(matrices)
    sizes = [matrices[0].rows, *[m.cols for m in matrices]]
    cost: dict[tuple[int, int], tuple[int, int]] = {(i, i): (0, i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            cost[i, j] = min((cost[i, k][0] + cost[k + 1, j][0] + sizes[i] * sizes[k + 1] * sizes[j + 1], k) for k in range(i, j))

    def build(i: int, j: int) -> BlockMatrix:
        k = cost[i, j][1]
        return matrices[i] if i == j else build(i, k).multiply(build(k + 1, j))

    return build(0, n - 1)


def power(x: BlockMatrix, n: int) -> BlockMatrix:
    """A product of n equal square matrices by squaring; each square is computed once."""
    if x.rows != x.cols or n < 0:
        raise ValueError("a power needs a square matrix and a number of factors")
    if n == 0:
        return BlockMatrix.identity(x.df.sparkSession, x.rows, x.side)
    out = None
    while True:
        if n & 1:
            out = x if out is None else out.multiply(x)
        n >>= 1
        if not n:
            return out
        square = x.multiply(x)
        # the last square is read once, so it isn't kept
        x = BlockMatrix(cut(square.df), x.rows, x.cols, x.side) if n > 1 else square
