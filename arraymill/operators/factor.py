"""Factors, inverses and determinants of matrices in tiles.

Elimination halves the columns: the left half is factored, the right half's upper part solved against it, its
lower part loses their product, and is factored in turn. So what is left is written once a halving and not once
for each tile of the diagonal, and most of the work are products of large parts. A single column of tiles is
factored along its diagonal tile. That tile's own pivots are those of the whole column if no multiplier below
exceeds 1; elsewhere a tournament chooses them: each tile of the column offers its best rows, and winners of groups
meet until one tile's worth of rows is left. All tables are in the shared folder, so a lost executor costs
its tasks, and go as soon as they are read for the last time. The driver holds single tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import Tables
from . import blocks
from .blocks import SCHEMA, BlockMatrix, _batch, _packed, _ranged, _rows, kept_product

#: Sides of tiles, and columns of tiles that the larger ones are to leave of a matrix.
SIDES, ROUNDS = (128, 256, 512, 1024, 2048), 12
#: Offers that one task compares in a round of a tournament.
FAN_IN = 4
#: Bytes of tiles in a table's file, as they are when read.
READ = 32 << 20
#: Columns that are eliminated one by one within a tile.
NARROW = 32
#: What a diagonal tile's table holds, by kind.
LOW, UP, INTO_LOW, INTO_UP, ORDER = range(5)


def side_for(n: int) -> int:
    """The side of tiles for a matrix of n rows: each column of them costs several jobs, and a tile must fit a task."""
    return next((s for s in SIDES if n <= s * ROUNDS), SIDES[-1])


def _eliminate(m: np.ndarray, pivot: bool) -> np.ndarray:
    """L, below the diagonal, and U in the place of m; with pivots the order of its rows. A column of zeros is left as it is."""
    order, (n, width) = np.arange(len(m)), m.shape
    if width <= NARROW:
        for k in range(min(n, width)):
            if pivot and (best := k + int(np.argmax(np.abs(m[k:, k])))) != k:
                m[[k, best]], order[[k, best]] = m[[best, k]], order[[best, k]]
            if m[k, k] != 0:
                m[k + 1 :, k] /= m[k, k]
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
            elif not pivot:
                raise ValueError("a pivot is zero")
        return order
    half = width // 2
    own = _eliminate(m[:, :half], pivot)
    order = order[own]
    if pivot:
        m[:, half:] = m[own, half:]
    if n > half:
        m[:half, half:] = np.linalg.inv(np.tril(m[:half, :half], -1) + np.eye(half)) @ m[:half, half:]
        m[half:, half:] -= m[half:, :half] @ m[:half, half:]
        own = _eliminate(m[half:, half:], pivot)
        if pivot:
            m[half:, :half] = m[half:, :half][own]
            order[half:] = order[half:][own]
    return order


def small_lu(m: np.ndarray, pivot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L and U of a tile and the order of its rows in them."""
    work = m.astype(float).copy()
    order = _eliminate(work, pivot)
    return np.tril(work, -1) + np.eye(len(work)), np.triu(work), order


def best_rows(m: np.ndarray) -> np.ndarray:
    """Which rows partial pivoting takes, in its order; as many as there are columns."""
    most = min(m.shape)
    return _eliminate(m[:, :most].astype(float), True)[:most]


def _shaped(data: bytes, height: int) -> np.ndarray:
    return np.frombuffer(data).reshape(height, -1)


class _Work:
    """One factorization or solution: its tables and the matrix's extent."""

    def __init__(self, spark: SparkSession, name: str, n: int, side: int):
        self.tables, self.n, self.side = Tables(spark, name, max(1, READ // (8 * side * side))), n, side
        self.cores = spark.sparkContext.defaultParallelism

    def extent(self, k: int) -> int:
        return min(self.side, self.n - k * self.side)

    def tiles(self, paths: list[str]) -> DataFrame:
        return self.tables.read(SCHEMA, *paths) if paths else self.tables.spark.createDataFrame([], SCHEMA)


def _of(kind: int, paths: list[str]) -> list[str]:
    return [f"{path}/kind={kind}" for path in paths]


def _within(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return df.filter((F.col("brow") >= rows[0]) & (F.col("brow") < rows[1]) & (F.col("bcol") >= cols[0]) & (F.col("bcol") < cols[1]))


@dataclass(frozen=True, eq=False)
class Factors:
    """``rows[i]`` is the matrix's row that is i-th in ``lower`` times ``upper``. Tables of diagonal tiles, below and above them."""

    work: _Work
    rows: list[int]
    diagonal: list[str]
    below: list[str] = field(default_factory=list)
    above: list[str] = field(default_factory=list)

    def _part(self, kind: int, paths: list[str], lower: bool) -> BlockMatrix:
        made = self.work.tiles([*_of(kind, self.diagonal), *paths])
        return BlockMatrix(made.unionByName(_zeros(self.work, lower)), self.work.n, self.work.n, self.work.side)

    @property
    def lower(self) -> BlockMatrix:
        return self._part(LOW, self.below, True)

    @property
    def upper(self) -> BlockMatrix:
        return self._part(UP, self.above, False)

    def determinant(self) -> tuple[float, float]:
        """Sign and logarithm of the absolute value."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, _, data in _rows(batches):
                own = np.frombuffer(data)
                own = own[:: int(np.sqrt(len(own))) + 1]
                with np.errstate(divide="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array([brow], pa.int64()), pa.array([float(np.prod(np.sign(own)))]), pa.array([float(np.log(np.abs(own)).sum())])], ["brow", "sign", "log"])

        made = self.work.tiles(_of(UP, self.diagonal)).mapInArrow(run, "brow long, sign double, log double").collect()
        made.sort(key=lambda r: r["brow"])
        return _parity(self.rows) * float(np.prod([r["sign"] for r in made])), float(sum(r["log"] for r in made))

    def solve(self, right: BlockMatrix) -> BlockMatrix:
        """X with matrix times X equal to the right side."""
        return self._solved(_moved(right.df, right.side, right.rows, {old: new for new, old in enumerate(self.rows) if old != new}), right.cols)

    def inverse(self) -> BlockMatrix:
        n, side, rows = self.work.n, self.work.side, self.rows

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    own = np.array(rows[k * side : (k + 1) * side], int)
                    for bcol in np.unique(own // side):
                        here = own // side == bcol
                        tile = np.zeros((len(own), min(side, n - int(bcol) * side)))
                        tile[np.flatnonzero(here), own[here] % side] = 1.0
                        yield _batch({(k, int(bcol)): tile})

        return self._solved(self.work.tables.spark.range(-(-n // side)).mapInArrow(moved, SCHEMA), n)

    def _solved(self, right: DataFrame, width: int) -> BlockMatrix:
        own, work = self.work, _Work(self.work.tables.spark, "solve", self.work.n, self.work.side)
        if not own.n or not width:
            return BlockMatrix(own.tiles([]), own.n, width, own.side)
        down, across = -(-own.n // own.side), -(-width // own.side)
        begin = [work.tables.write(right)]
        half = _triangular(work, self.below, _of(INTO_LOW, self.diagonal), work.tiles(begin), (0, down), (0, across), width, True)
        work.tables.drop(*begin)
        made = _triangular(work, self.above, _of(INTO_UP, self.diagonal), work.tiles(half), (0, down), (0, across), width, False)
        work.tables.drop(*half)
        return BlockMatrix(work.tiles(made), own.n, width, own.side)

    def unmoved(self, x: BlockMatrix) -> BlockMatrix:
        """Rows in the factors' order, back in the matrix's own."""
        return BlockMatrix(_moved(x.df, x.side, x.rows, {new: old for new, old in enumerate(self.rows) if old != new}), x.rows, x.cols, x.side)


def _zeros(work: _Work, lower: bool) -> DataFrame:
    """Tiles of zeros on a triangle's other side."""
    side, n, down = work.side, work.n, -(-work.n // work.side)

    def zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                brow, bcol = divmod(place, down)
                if brow != bcol and (brow < bcol) == lower:
                    yield _batch({(brow, bcol): np.zeros((min(side, n - brow * side), min(side, n - bcol * side)))})

    return work.tables.spark.range(down * down).mapInArrow(zeros, SCHEMA)


def _parity(rows: list[int]) -> float:
    sign, seen = 1.0, set()
    for start in range(len(rows)):
        at, length = start, 0
        while at not in seen:
            seen.add(at)
            at, length = rows[at], length + 1
        sign = -sign if length and length % 2 == 0 else sign
    return sign


def _mapped(df: DataFrame, f: Callable[[int, int, bytes], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for brow, bcol, data in _rows(batches):
            yield _batch({(brow, bcol): f(brow, bcol, data)})

    return df.select("brow", "bcol", "data").mapInArrow(run, SCHEMA)


def _moved(df: DataFrame, side: int, height: int, moves: dict[int, int]) -> DataFrame:
    """Tiles with some rows at other places; the places they come from are taken by others of them."""
    if not moves:
        return df
    strips = sorted({row // side for row in moves})

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for brow, bcol, data in _rows(batches):
            tile = _shaped(data, min(side, height - brow * side))
            own = [(moves[r], r - brow * side) for r in range(brow * side, brow * side + len(tile)) if r in moves]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([new // side for new, _ in own], pa.int64()), pa.array([bcol] * len(own), pa.int64()), pa.array([new % side for new, _ in own], pa.int64()), pa.array([tile[r].tobytes() for _, r in own], pa.binary())], ["brow", "bcol", "r", "piece"])

    def put(key: tuple, tile: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            raise ValueError("a tile is missing where rows change places")
        out = _shaped(tile["data"].iloc[0], min(side, height - int(key[0]) * side)).copy()
        for r, piece in zip(rows["r"], rows["piece"], strict=True):
            out[r] = np.frombuffer(piece)
        return pd.DataFrame({"brow": [key[0]], "bcol": [key[1]], "data": [_packed(out)]})

    df = df.select("brow", "bcol", "data")
    touched = df.filter(F.col("brow").isin(strips))
    pieces = touched.mapInArrow(cut_out, "brow long, bcol long, r long, piece binary")
    put_in = touched.groupBy("brow", "bcol").cogroup(pieces.groupBy("brow", "bcol")).applyInPandas(put, SCHEMA)
    return df.filter(~F.col("brow").isin(strips)).unionByName(put_in)


def _after(first: dict[int, int], then: dict[int, int]) -> dict[int, int]:
    """Moves of rows, followed by others."""
    both = {row: then.get(new, new) for row, new in first.items()} | {row: new for row, new in then.items() if row not in first}
    return {row: new for row, new in both.items() if row != new}


def _tournament(work: _Work, column: DataFrame, width: int) -> list[int]:
    """The rows of a column of tiles that win as pivots, in order."""
    side = work.side

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = np.zeros(0, int), np.zeros((0, width))
        for start, ids, data in _rows(batches):
            tile = np.frombuffer(data).reshape(-1, width)
            own = np.frombuffer(ids, np.int64) if ids else np.arange(start * side, start * side + len(tile))
            names, values = np.concatenate([names, own]), np.vstack([values, tile])
            best = best_rows(values)
            names, values = names[best], values[best]
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([names.astype(np.int64).tobytes()], pa.binary()), pa.array([_packed(values)], pa.binary())], ["brow", "ids", "data"])

    kind = "brow long, ids binary, data binary"
    path = work.tables.write(column.select("brow", F.lit(None).cast("binary").alias("ids"), "data").mapInArrow(offer, kind))
    while (n := work.tables.read("brow long", path).count()) > 1:
        met = work.tables.read(kind, path).repartition(-(-n // FAN_IN)).mapInArrow(offer, kind)
        path, before = work.tables.write(met), path
        work.tables.drop(before)
    ids = work.tables.read("ids binary", path).first()["ids"]
    work.tables.drop(path)
    return np.frombuffer(ids, np.int64).tolist()


def _diagonal(work: _Work, column: DataFrame, k: int, pivot: bool) -> tuple[str, np.ndarray | None, list[int]]:
    """A table of the diagonal tile's factors and their inverses by kind, the inverse of the upper one and the order of rows; none of a singular tile."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for brow, bcol, data in _rows(batches):
            tile = np.frombuffer(data)
            low, up, order = small_lu(tile.reshape(int(np.sqrt(len(tile))), -1), pivot)
            made = [(ORDER, order.astype(np.int64).tobytes())]
            if (np.diag(up) != 0).all():
                made += [(LOW, _packed(low)), (UP, _packed(up)), (INTO_LOW, _packed(np.linalg.inv(low))), (INTO_UP, _packed(np.linalg.inv(up)))]
            elif not pivot:
                raise ValueError("a pivot is zero")
            for kind, cells in made:
                yield pa.RecordBatch.from_arrays([pa.array([brow], pa.int64()), pa.array([bcol], pa.int64()), pa.array([cells], pa.binary()), pa.array([kind], pa.int32())], ["brow", "bcol", "data", "kind"])

    made = column.filter(F.col("brow") == k).select("brow", "bcol", "data").mapInArrow(split, f"{SCHEMA}, kind int")
    path = work.tables.write(made, "kind")
    found = {r["kind"]: r["data"] for r in work.tables.read(f"{SCHEMA}, kind int", path).filter(F.col("kind").isin(INTO_UP, ORDER)).collect()}
    inverse = _shaped(found[INTO_UP], work.extent(k)) if INTO_UP in found else None
    return path, inverse, np.frombuffer(found[ORDER], np.int64).tolist()


def _column(work: _Work, part: DataFrame, k: int, pivot: bool) -> tuple[str, list[str], dict[int, int]]:
    """A column of tiles factored: tables of its diagonal tile and of those below, and moves of rows."""
    first, last = k * work.side, (k + 1) * work.side >= work.n

    def below(column: DataFrame, inverse: np.ndarray) -> str:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, bcol, data in _rows(batches):
                tile = np.frombuffer(data).reshape(-1, len(inverse)) @ inverse
                yield _batch({(brow, bcol): tile}).append_column("most", pa.array([float(np.abs(tile).max())]))

        return work.tables.write(column.filter(F.col("brow") > k).select("brow", "bcol", "data").mapInArrow(run, f"{SCHEMA}, most double"))

    path, inverse, order = _diagonal(work, part, k, pivot)
    moves = {first + old: first + new for new, old in enumerate(order) if old != new}
    if inverse is not None and last:
        return path, [], moves
    if inverse is not None:
        made = below(part, inverse)
        if not pivot or work.tables.read("most double", made).agg(F.max("most")).first()[0] <= 1 + 1e-8:
            return path, [made], moves
        work.tables.drop(made)
    work.tables.drop(path)
    if last:
        raise ValueError("a pivot is zero")
    winners = _tournament(work, part, work.extent(k))
    # a winner and the row at its new place change places, one after the other
    place = {r: r for r in [*winners, *range(first, first + work.extent(k))]}
    at = {r: r for r in place}
    for new, row in enumerate(winners, first):
        old, other = at[row], place[new]
        place[new], place[old], at[row], at[other] = row, other, new, old
    moves = {row: new for row, new in at.items() if row != new}
    moved = work.tables.write(_moved(part, work.side, work.n, moves))
    path, inverse, order = _diagonal(work, work.tiles([moved]), k, True)
    if inverse is None:
        raise ValueError("a pivot is zero")
    made = below(work.tiles([moved]), inverse)
    work.tables.drop(moved)
    return path, [made], _after(moves, {first + old: first + new for new, old in enumerate(order) if old != new})


def _triangular(work: _Work, triangle: list[str], inverses: list[str], right: DataFrame, rows: tuple[int, int], cols: tuple[int, int], width: int, lower: bool) -> list[str]:
    """Tables of X with the triangle times X equal to the right side, in ranges of tile rows and columns."""
    (lo, hi), across = rows, cols[1] - cols[0]
    tile, strip = 8 * work.side * work.side, 8 * work.side * min(work.side, width)
    # a task holds columns of as many tiles and reads the triangle; of a narrow right side it must not read it whole
    most = min(blocks.SQUARE // strip, 4 * across, math.isqrt(2 * blocks.DEALT // (tile * work.cores)))
    if hi - lo <= max(1, most):
        group = max(1, min(blocks.SQUARE // (strip * max(1, hi - lo)), -(-across // (2 * work.cores))))
        at_once = group * work.cores * max(1, 2 * blocks.DEALT // (tile * work.cores * max(1, hi - lo) ** 2))
        passes = [(first, min(first + at_once, cols[1])) for first in range(cols[0], cols[1], at_once)]
        return [work.tables.write(_swept(work, triangle, inverses, _within(right, rows, own), rows, own, group, lower)) for own in passes]
    mid = (lo + hi) // 2
    near, far = ((lo, mid), (mid, hi)) if lower else ((mid, hi), (lo, mid))
    own = _triangular(work, triangle, inverses, _within(right, near, cols), near, cols, width, lower)
    rest = kept_product(work.tables, _within(work.tiles(triangle), far, near), work.tiles(own), work.side, (work.n, width), far, cols, near[1] - near[0], plus=_within(right, far, cols), minus=True)
    other = _triangular(work, triangle, inverses, work.tiles(rest), far, cols, width, lower)
    work.tables.drop(*rest)
    return own + other


def _swept(work: _Work, triangle: list[str], inverses: list[str], right: DataFrame, rows: tuple[int, int], cols: tuple[int, int], group: int, lower: bool) -> DataFrame:
    """Columns of the right side solved each in a task, which reads the triangle's tiles in their order, ``group`` columns of tiles at a time; absent tiles are zeros."""
    (lo, hi), side, n = rows, work.side, work.n
    stacks = -(-(cols[1] - cols[0]) // group)
    order = F.col("bcol") - lo if lower else hi - 1 - F.col("bcol")
    every = _ranged(0, stacks - 1).alias("_stack")
    parts = [_within(work.tiles(inverses), rows, rows).select(every, order.alias("_k"), F.lit(0).alias("_which"), "brow", "bcol", "data")]
    if triangle:
        parts.append(_within(work.tiles(triangle), rows, rows).select(every, order.alias("_k"), F.lit(1).alias("_which"), "brow", "bcol", "data"))
    stack = F.call_function("div", F.col("bcol") - cols[0], F.lit(group).cast("long"))
    dealt = right.select(stack.alias("_stack"), F.lit(-1).cast("long").alias("_k"), F.lit(-1).alias("_which"), "brow", "bcol", "data")
    for part in parts:
        dealt = dealt.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, solved = None, {}, {}
        for stack, _, which, brow, bcol, data in _rows(batches):
            if stack != own:
                own, held, solved = stack, {}, {}
            tile = np.frombuffer(data).reshape(min(side, n - brow * side), -1)
            if which == -1:
                held[brow, bcol] = tile
            elif which == 0:
                solved = {c: tile @ held.pop((r, c)) for r, c in list(held) if r == brow}
                yield from (_batch({(brow, c): x}) for c, x in solved.items())
            else:
                for c, x in solved.items():
                    made = tile @ x
                    held[brow, c] = held[brow, c] - made if (brow, c) in held else -made

    cells = ["_stack", "_k", "_which", "brow", "bcol"]
    return dealt.repartitionById(stacks, F.col("_stack").cast("int")).sortWithinPartitions(*cells).select(*cells, "data").mapInArrow(run, SCHEMA)


def lu(x: BlockMatrix, pivot: bool = True, lower: bool = True) -> Factors:
    """Lower and upper factors of a square matrix; with pivots of rows the rows in their new order.

    Without ``lower`` the tiles below the diagonal go as soon as nothing needs them, as a determinant doesn't.
    """
    if x.rows != x.cols:
        raise ValueError("factors need a square matrix")
    work = _Work(x.df.sparkSession, "lu", x.rows, x.side)
    down = -(-x.rows // x.side)

    def factored(part: DataFrame, own: list[str], lo: int, hi: int) -> tuple[list[str], list[str], list[str], dict[int, int]]:
        """Tables of diagonal tiles, below and above, and moves, of the columns of a part. ``own`` goes when the part was read."""
        if lo == hi:
            return [], [], [], {}
        if hi - lo == 1:
            path, below, moves = _column(work, part, lo, pivot)
            work.tables.drop(*own)
            return [path], below, [], moves
        mid = (lo + hi) // 2
        diagonal, below, above, moves = factored(part.filter(F.col("bcol") < mid), [], lo, mid)
        right = part.filter(F.col("bcol") >= mid)
        if moves:
            moved = work.tables.write(_moved(right, work.side, work.n, moves))
            work.tables.drop(*own)
            right, own = work.tiles([moved]), [moved]
        beside = _triangular(work, below, _of(INTO_LOW, diagonal), right.filter(F.col("brow") < mid), (lo, mid), (mid, hi), work.n, True)
        ahead, lost = work.tiles(below).filter(F.col("brow") >= mid), right.filter(F.col("brow") >= mid)
        rest = kept_product(work.tables, ahead, work.tiles(beside), work.side, (work.n, work.n), (mid, down), (mid, hi), mid - lo, plus=lost, minus=True)
        work.tables.drop(*own)
        if not lower and hi == down:
            work.tables.drop(*below)
            below = []
        then = factored(work.tiles(rest), rest, mid, hi)
        if then[3] and below:
            moved = work.tables.write(_moved(work.tiles(below), work.side, work.n, then[3]))
            work.tables.drop(*below)
            below = [moved]
        return diagonal + then[0], below + then[1], above + beside + then[2], _after(moves, then[3])

    begin = work.tables.write(x.df.select("brow", "bcol", "data"))
    diagonal, below, above, moves = factored(work.tiles([begin]), [begin], 0, down)
    rows = list(range(x.rows))
    for row, new in moves.items():
        rows[new] = row
    return Factors(work, rows, diagonal, below, above)


def inverse(x: BlockMatrix) -> BlockMatrix:
    return lu(x).inverse()


def cholesky(x: BlockMatrix) -> BlockMatrix:
    """The lower factor of a symmetric, positive definite matrix, whose tiles above the diagonal aren't read; an error for others."""
    if x.rows != x.cols:
        raise ValueError("factors need a square matrix")
    work = _Work(x.df.sparkSession, "cholesky", x.rows, x.side)

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for brow, bcol, data in _rows(batches):
            tile = np.frombuffer(data)
            low = np.linalg.cholesky(tile.reshape(int(np.sqrt(len(tile))), -1))
            for kind, made in ((LOW, low), (INTO_LOW, np.linalg.inv(low))):
                yield _batch({(brow, bcol): made}).append_column("kind", pa.array([kind], pa.int32()))

    def flipped(df: DataFrame) -> DataFrame:
        side, n = work.side, work.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for brow, bcol, data in _rows(batches):
                yield _batch({(bcol, brow): _shaped(data, min(side, n - brow * side)).T})

        return df.select("brow", "bcol", "data").mapInArrow(run, SCHEMA)

    def factored(part: DataFrame, own: list[str], lo: int, hi: int) -> tuple[list[str], list[str]]:
        """Tables of diagonal tiles and below, of a square along the diagonal."""
        if lo == hi:
            return [], []
        if hi - lo == 1:
            path = work.tables.write(part.select("brow", "bcol", "data").mapInArrow(root, f"{SCHEMA}, kind int"), "kind")
            work.tables.drop(*own)
            return [path], []
        mid = (lo + hi) // 2
        diagonal, below = factored(_within(part, (lo, mid), (lo, mid)), [], lo, mid)
        # the part below is solved as the columns of its transpose
        turned = _triangular(work, below, _of(INTO_LOW, diagonal), flipped(_within(part, (mid, hi), (lo, mid))), (lo, mid), (mid, hi), work.n, True)
        column = work.tables.write(flipped(work.tiles(turned)))
        rest = kept_product(work.tables, work.tiles([column]), work.tiles(turned), work.side, (work.n, work.n), (mid, hi), (mid, hi), mid - lo, plus=_within(part, (mid, hi), (mid, hi)), minus=True, lower=True)
        work.tables.drop(*own, *turned)
        then = factored(work.tiles(rest), rest, mid, hi)
        return diagonal + then[0], [*below, column, *then[1]]

    begin = work.tables.write(x.df.filter("brow >= bcol").select("brow", "bcol", "data"))
    diagonal, below = factored(work.tiles([begin]), [begin], 0, -(-x.rows // x.side))
    return Factors(work, list(range(x.rows)), diagonal, below).lower
