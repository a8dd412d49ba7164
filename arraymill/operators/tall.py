"""Orthogonal factors of tall matrices: least squares and singular values without squaring the condition.

A row of the matrix is an array of a table's row. A task folds its rows, block by block, into the
triangular factor of what it has read; triangles are stacked and folded again in a tree of bounded width
until one is left, as large as the columns squared. Nothing of the rows' number leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..plans.cut import cut
from ..plans.small import computed

#: Triangles that a task folds into one.
FAN_IN = 32
#: Cells of a block of rows.
BLOCK = 1 << 20
#: Columns of a matrix whose triangle is small.
MOST_COLUMNS = 2_000


def _folded(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    stacked = rows if held is None else np.vstack([held, rows])
    return np.linalg.qr(stacked, mode="r") if len(stacked) > stacked.shape[1] else stacked


def _triangle(part: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part.shape[1]], pa.int64()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], ["width", "data"])


def triangle(rows: DataFrame, *columns: Column) -> np.ndarray:
    """The upper triangular factor of the rows, whose cells are the columns in their sequence.

    A row with a null cell is left out. Fewer rows than columns give the rows' own triangle, filled up
    with zeros; none give zeros.
    """
    width = len(columns)
    if width > MOST_COLUMNS:
        raise ValueError("the matrix has too many columns")
    cells = rows.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        step = max(width, BLOCK // width)
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, width))
            for at in range(0, len(block), step):
                held = _folded(held, block[at : at + step])
        yield from _triangle(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for data in batch.column(1):
                held = _folded(held, np.frombuffer(data.as_py()).reshape(-1, width))
        yield from _triangle(held)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                yield from _triangle(np.linalg.qr(np.frombuffer(data.as_py()).reshape(-1, width), mode="r"))

    parts = cut(cells.mapInArrow(fold, "width long, data binary"))
    n = parts.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = cut(parts.repartition(n).mapInArrow(again, "width long, data binary"))
    last = parts.coalesce(1).mapInArrow(again, "width long, data binary").mapInArrow(final, "width long, data binary").first()
    out = np.zeros((width, width))
    if last is not None:
        own = np.frombuffer(last["data"]).reshape(-1, width)
        out[: len(own)] = own
    return out


def scaled_pinv(r: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """Pseudo-inverse of a triangle after its columns are brought to one length, so that units don't decide
    which directions count."""
    length = np.linalg.norm(r, axis=0)
    length[length == 0] = 1
    cutoff = len(r) * np.finfo(float).eps if tolerance is None else tolerance
    return np.linalg.pinv(r / length, rcond=cutoff) / length[:, None]


def lstsq(rows: DataFrame, features: Sequence[Column], targets: Sequence[Column], tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients, a column for each target, and each target's residual length.

    Targets are folded with the features, so their part of the triangle is what the orthogonal factor
    would give. Dependent features share what they explain.
    """
    n = len(features)
    r = triangle(rows, *features, *targets)
    own = lambda m: (scaled_pinv(m[:n, :n], tolerance) @ m[:n, n:], np.linalg.norm(m[n:, n:], axis=0))
    coefficients, residual = computed(rows.sparkSession, own, r)
    return coefficients, residual


def singular_values(rows: DataFrame, *columns: Column) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the rows, falling, and the right vectors as rows."""
    s, vt = computed(rows.sparkSession, lambda r: np.linalg.svd(r)[1:], triangle(rows, *columns))
    return s, vt


def svd(rows: DataFrame, columns: Sequence[Column], prefix: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows with their left vectors' cells ``u0, u1, ...``, the singular values and the right vectors.

    Directions without length are left out.
    """
    s, vt = singular_values(rows, *columns)
    kept = s > len(s) * np.finfo(float).eps * (s[0] if len(s) else 0)
    s, vt = s[kept], vt[kept]
    cell = lambda v, length: sum((c.cast("double") * float(w) for c, w in zip(columns[1:], v[1:], strict=True)), columns[0].cast("double") * float(v[0])) / float(length)
    return rows.select("*", *[cell(v, length).alias(f"{prefix}{i}") for i, (v, length) in enumerate(zip(vt, s, strict=True))]), s, vt
