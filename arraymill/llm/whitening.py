"""Whitening of embeddings by a randomised range finder and a Rayleigh-Ritz step.

A vector's entries become integers, so that counts, sums and deviations are exact. The range finder
multiplies the covariance by a random block with more columns than components are wanted, in passes over
all centred rows; each further pass multiplies by the last block's orthonormal basis. Rayleigh-Ritz on the
basis gives eigenvalues and components with their residuals; where a residual isn't at rounding level
after the last pass, the basis is expanded to the full dimension, where the step is exact.

A pass yields some sums a partition, added up by place before and after a shuffle; the driver gets a
matrix of the dimension's size, never rows, and one task decomposes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.small import computed

COMPONENTS = 8
OVERSAMPLING = 8
POWER_PASSES = 3
SCALE, SHIFT = 1024, 100_000
#: Entries of a batch's matrix at a time.
BLOCK = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is there and has entries, all of them finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integers(batch: pa.RecordBatch, place: int, width: int) -> np.ndarray:
    """The batch's vectors as rows of integers; vectors of different lengths are an error."""
    lists = batch.column(place)
    if pa.types.is_large_list(lists.type) or pa.types.is_list(lists.type):
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        if (lengths != width).any():
            raise ValueError(f"a vector has {lengths[lengths != width][0]} entries, not {width}")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    scaled = np.floor(SCALE * values)
    if (np.abs(scaled) > 2.0**52).any():
        raise ValueError("an entry is too large for whole numbers")
    return scaled.astype(np.int64) + SHIFT


def _summed(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int, width: int, kind: str) -> np.ndarray:
    """``partial`` of all rows' integers, an array of numbers that add up, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            step = max(1, BLOCK // width)
            for at in range(0, batch.num_rows, step):
                total += partial(integers(batch.slice(at, step), 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int64)), pa.array(total)], ["at", "v"])

    sums = vectors.mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted model: rows of ``basis`` are the components, by falling eigenvalue, ``values`` their
    eigenvalues. n and ``sums`` are those of the integers, ``total`` the covariance's trace, ``expanded``
    whether the full dimension was needed, ``passes`` over the rows. Without vectors n is 0."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float
    expanded: bool
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the rows less their mean, exact."""
        top = int(np.abs(x - SHIFT).max(initial=0)) + SHIFT
        if self.n * top * 2 >= 2**63:
            raise OverflowError("deviations exceed 64 bits")
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.basis.T / np.sqrt(self.values)


def _products(model: Whitening, block: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of rows X, centred: X'(X block), and the rows' squared length behind it."""

    def run(x: np.ndarray) -> np.ndarray:
        rows = model.centred(x) / model.n
        return np.append((rows.T @ (rows @ block)).ravel(), (rows * rows).sum())

    return run


def _orthonormal(m: np.ndarray) -> tuple[np.ndarray, ...]:
    return (np.linalg.qr(m)[0],)


def _ritz(block: np.ndarray, image: np.ndarray, components: int) -> tuple[np.ndarray, ...]:
    """Eigenvalues, falling, components and residuals of the covariance on a basis, given its image."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    basis = block @ turn
    return values, basis, np.linalg.norm(image @ turn - basis * values, axis=0)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, power_passes: int = POWER_PASSES, seed: int = 0) -> Whitening:
    """The whitening of all usable vectors of a table.

    Only components with an eigenvalue above rounding level are kept, so few or constant vectors have
    fewer than asked for, and equal ones none.
    """
    vectors = df.filter(usable(F.col(vector))).select(F.col(vector).alias("v"))
    first = vectors.select(F.size("v").alias("d")).first()
    if first is None:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, False, 0)
    d = first["d"]
    # of the entries less the shift, so that the sums stay far from 64 bits; one more for the count
    sums = _summed(vectors, lambda x: np.append((x - SHIFT).sum(axis=0), len(x)), d + 1, d, "long")
    n = int(sums[d])
    model = Whitening(n, sums[:d] + n * SHIFT, np.zeros((0, d)), np.zeros(0), 0.0, 0.0, False, 1)
    width = min(d, components + oversampling)
    block = np.random.default_rng(seed).standard_normal((d, width))
    block = computed(df.sparkSession, _orthonormal, block)[0] if width < d else np.eye(d)
    expanded, passes = width == d, 1
    while True:
        out = _summed(vectors, _products(model, block), d * block.shape[1] + 1, d, "double") / n
        image, total, passes = out[:-1].reshape(d, -1), float(out[-1]), passes + 1
        values, basis, residual = computed(df.sparkSession, lambda b, i: _ritz(b, i, components), block, image)
        rounding = 4 * d * np.finfo(float).eps * max(float(values[0]), 0.0)
        if expanded or (residual <= rounding / (2 * np.sqrt(d))).all():
            break
        if passes - 1 > power_passes:
            block, expanded = np.eye(d), True
        else:
            block = computed(df.sparkSession, _orthonormal, image)[0]
    kept = values > rounding
    model = Whitening(n, model.sums, basis.T[kept], values[kept], total, 0.0, expanded, passes)
    k = int(kept.sum())
    if not k:
        return model
    gram = _summed(vectors, lambda x: (lambda w: (w.T @ w).ravel())(model.project(x)), k * k, d, "double").reshape(k, k) / n
    return Whitening(n, model.sums, model.basis, model.values, total, float(np.abs(gram - np.eye(k)).max()), expanded, passes + 1)


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable vector and component ``key, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the sum over dimensions of (n x - S)^2, exact; an error where it exceeds 64 bits.
    """
    rows = df.filter(usable(F.col(vector))).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    own, k, d = df.schema[key].dataType.simpleString(), len(model.values), len(model.sums)
    if not model.n:
        rows = rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK // max(d, 1))
            for at in range(0, batch.num_rows if k else 0, step):
                part = batch.slice(at, step)
                x = integers(part, 1, d)
                apart = model.centred(x)
                far = np.square(apart.astype(np.float64)).sum(axis=1).max()
                if far >= 2.0**63:
                    raise OverflowError("deviations exceed 64 bits")
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(np.repeat((apart * apart).sum(axis=1), k)), pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.total, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"key {own}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("key", key)


def whitened(df: DataFrame) -> DataFrame:
    """``fit`` and ``transform`` of a table of embeddings.

    Defined results: vectors that are null, empty, or hold null or non-finite entries are no rows of the
    result and don't count; vectors that differ in length are an error. Repeated rows count and come back
    as often as they are there; a null vec_id comes back as null. Components with equal eigenvalues are
    some basis of their space. Vectors without spread, or none at all: no rows. Other columns don't matter.
    """
    return transform(df, fit(df))
