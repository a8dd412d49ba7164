"""Products of vectors and matrices, covariance and small dense linear algebra.

Products are join-aggregates over the cells that are there: the inner dimension is the join key and
partial sums are combined before the shuffle; an absent cell is a zero that meets nothing. Matrices with
all their cells multiply in tiles, in ``blocks``, and are factored in tiles, in ``factor``, or along their
rows, in ``tall``. Many small matrices, one a key, go through ``per_matrix``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from . import blocks, factor, tall
from .grid import Axis, Grid
from .layout import transpose


def matmul(a: Grid, b: Grid) -> Grid:
    if a.cols != b.rows:
        raise ValueError("inner dimensions differ")
    left = a.df.select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    right = b.df.select(F.col("row").alias("_k"), "col", F.col("value").alias("_b"))
    sums = left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    return Grid(sums, a.rows, b.cols)


def filled(x: Grid) -> Grid:
    """Missing cells as zeros."""
    from .layout import resize

    return resize(x, x.rows, x.cols)


def inner(a: Grid, b: Grid) -> DataFrame:
    """Sum of products of two flat grids."""
    if a.size != b.size:
        raise ValueError("lengths differ")
    left, right = (g.df.select(g.idx.alias("_k"), F.col("value").alias(n)) for g, n in ((a, "_a"), (b, "_b")))
    return left.join(right, "_k").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def dot(a: Grid, b: Grid) -> Grid | DataFrame:
    """Inner product of flat grids of a shape, else the matrix product."""
    return inner(a, b) if a.shape == b.shape and a.isflat() else matmul(a, b)


def outer(a: Grid, b: Grid) -> Grid:
    """All products of two vectors: the result has a cell for each, so its size is the cost."""
    cells = a.df.sparkSession.range(a.size * b.size).select(F.floor(F.col("id") / b.size).cast("long").alias("row"), (F.col("id") % b.size).alias("col"))
    left = a.df.select(a.idx.alias("row"), F.col("value").alias("_a"))
    right = b.df.select(b.idx.alias("col"), F.col("value").alias("_b"))
    return Grid(cells.join(left, "row").join(right, "col").select("row", "col", (F.col("_a") * F.col("_b")).alias("value")), a.size, b.size)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    """Cross product of vectors of 2 (one value) or 3 components in columns."""
    if len(a) == 2:
        return [a[0] * b[1] - a[1] * b[0]]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def array_dot(a: Column, b: Column) -> Column:
    """Dot product of two array cells in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def multi_dot(grids: list[Grid]) -> Grid:
    """The product of several matrices, in tiles and in the sequence with the fewest multiplications."""
    return blocks.chain([blocks.BlockMatrix.from_grid(g) for g in grids]).to_grid()


def matrix_power(x: Grid, n: int) -> Grid:
    """Repeated products by squaring, in tiles; a negative power inverts first."""
    if not x.issquare():
        raise ValueError("a power needs a square matrix")
    return blocks.power(blocks.BlockMatrix.from_grid(inverse(x) if n < 0 else x), abs(n)).to_grid()


def cov(x: Grid, bias: bool = False) -> Grid:
    """Covariance of the rows as variables, in tiles of the columns centred before they are multiplied."""
    return blocks.BlockMatrix.from_grid(transpose(x)).covariance(bias).to_grid()


def corrcoef(x: Grid) -> Grid:
    """Covariance over the product of deviations; there are as many of these as variables."""
    own = cut(cov(x, bias=True).df)
    spread = own.filter("row = col").select(F.col("row").alias("_i"), F.sqrt("value").alias("_s"))
    down = own.join(spread, F.col("row") == F.col("_i")).withColumnRenamed("_s", "_down").drop("_i")
    both = down.join(spread, F.col("col") == F.col("_i"))
    return Grid(both.select("row", "col", (F.col("value") / F.col("_down") / F.col("_s")).alias("value")), x.rows, x.rows)


def cov_inv(x: Grid, bias: bool = False) -> Grid:
    return inverse(cov(x, bias))


#: Cells that a matrix may have where one task works on it.
MOST_CELLS = 4_000_000


def per_matrix(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], keys: list[str] | None = None) -> DataFrame:
    """f over each small matrix: ``keys, row, col, value`` in and out."""
    keys = keys or []
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " * bool(keys) + "row bigint, col bigint, value double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = int(group["row"].max()) + 1, int(group["col"].max()) + 1
        if rows * cols > MOST_CELLS:
            raise ValueError("the matrix is too large for one task")
        m = np.zeros((rows, cols))
        m[group["row"].to_numpy(), group["col"].to_numpy()] = group["value"].to_numpy()
        out = np.atleast_2d(f(m))
        r, c = np.indices(out.shape)
        made = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "value": out.ravel()})
        for k in keys:
            made[k] = group[k].iloc[0]
        return made[[*keys, "row", "col", "value"]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def _tiled(x: Grid) -> blocks.BlockMatrix:
    if not x.issquare():
        raise ValueError("a square matrix is needed")
    return blocks.BlockMatrix.from_grid(x, factor.side_for(x.rows))


def inverse(x: Grid) -> Grid:
    """By factors in tiles, with pivots."""
    return factor.inverse(_tiled(x)).to_grid()


def solve(a: Grid, b: Grid) -> Grid:
    """X with a times X equal to b."""
    return factor.lu(_tiled(a)).solve(blocks.BlockMatrix.from_grid(b, factor.side_for(a.rows))).to_grid()


def det(x: Grid) -> Grid:
    sign, log = factor.lu(_tiled(x), lower=False).determinant()
    return Grid.local(x.df.sparkSession, [sign * float(np.exp(log))])


def cholesky(x: Grid) -> Grid:
    """Lower factor of a positive definite matrix; an error for others."""
    return factor.cholesky(_tiled(x)).to_grid()


def lu_decomposition(x: Grid) -> tuple[Grid, Grid]:
    made = factor.lu(_tiled(x), pivot=False)
    return made.lower.to_grid(), made.upper.to_grid()


def pivot_lu_decomposition(x: Grid) -> tuple[Grid, Grid, Grid]:
    """L, U and P with P times the matrix equal to L times U."""
    made = factor.lu(_tiled(x))
    swapped = x.df.sparkSession.createDataFrame([(new, old, 1.0) for new, old in enumerate(made.rows)], "row long, col long, value double")
    return made.lower.to_grid(), made.upper.to_grid(), Grid(swapped, x.rows, x.rows)


def _wide_rows(x: Grid) -> tuple[DataFrame, list[Column]]:
    """A row of cells ``c0, c1, ...`` for each of the grid's; absent cells are zeros."""
    if x.cols > tall.MOST_COLUMNS:
        raise ValueError("the matrix has too many columns")
    cell = lambda c: F.coalesce(F.sum(F.when(F.col("col") == c, F.col("value").cast("double"))), F.lit(0.0)).alias(f"c{c}")
    every = x.df.select("row", "col", "value").unionByName(x.df.sparkSession.range(x.rows).select(F.col("id").alias("row")), allowMissingColumns=True)
    return every.groupBy("row").agg(*[cell(c) for c in range(x.cols)]), [F.col(f"c{c}") for c in range(x.cols)]


def _local(x: Grid, m: np.ndarray) -> Grid:
    return Grid.local(x.df.sparkSession, m.tolist())


def svd(x: Grid) -> tuple[Grid, Grid, Grid]:
    """U, the singular values as a flat grid, and V transposed, by orthogonal factors along the longer side.

    Directions without length are left out.
    """
    if x.rows < x.cols:
        u, s, vt = svd(transpose(x))
        return transpose(vt), s, transpose(u)
    rows, columns = _wide_rows(x)
    out, s, vt = tall.svd(rows, columns)
    cells = out.select("row", F.posexplode(F.array(*[F.col(f"u{i}") for i in range(len(s))])).alias("at", "value"))
    return Grid(cells.select("row", F.col("at").cast("long").alias("col"), "value"), x.rows, len(s)), _local(x, s), _local(x, vt)


def pinv(x: Grid) -> Grid:
    """By singular values: V over them times U transposed, row by row of U."""
    if x.rows < x.cols:
        return transpose(pinv(transpose(x)))
    rows, columns = _wide_rows(x)
    out, s, vt = tall.svd(rows, columns)
    cell = lambda j: sum((F.col(f"u{i}") * float(vt[i, j] / s[i]) for i in range(len(s))), F.lit(0.0))
    cells = out.select("row", F.posexplode(F.array(*[cell(j) for j in range(x.cols)])).alias("at", "value"))
    return Grid(cells.select(F.col("at").cast("long").alias("row"), F.col("row").alias("col"), "value"), x.cols, x.rows)


def lstsq(a: Grid, b: Grid, tolerance: float | None = None) -> np.ndarray:
    """Least-squares solution of a tall system, by orthogonal factors of its rows; absent cells are zeros."""
    if a.rows != b.rows:
        raise ValueError("the sides differ in rows")
    both = Grid(a.df.select("row", "col", "value").unionByName(b.df.select("row", (F.col("col") + a.cols).alias("col"), "value")), a.rows, a.cols + b.cols)
    rows, columns = _wide_rows(both)
    return tall.lstsq(rows, columns[: a.cols], columns[a.cols :], tolerance)[0]


def hat(x: Column, y: Column, z: Column) -> Column:
    """Skew-symmetric matrix of a vector."""
    zero = F.lit(0.0)
    return F.array(F.array(zero, -z, y), F.array(z, zero, -x), F.array(-y, x, zero))


def gauss_newton(rows: DataFrame, residual: Callable[[list[Column]], Column], jacobian: list[Callable[[list[Column]], Column]], start: list[float], iterations: int = 10) -> tuple[list[float], float]:
    """Nonlinear least squares: parameters after the iterations and the root mean square residual.

    An iteration sums J'J and J'r over the rows in one aggregation; only those few sums leave it.
    """
    beta = list(start)
    n = len(beta)
    for _ in range(iterations):
        p = [F.lit(float(b)) for b in beta]
        j, r = [f(p) for f in jacobian], residual(p)
        sums = rows.agg(*[F.sum(j[a] * j[b]).alias(f"m{a}_{b}") for a in range(n) for b in range(n)], *[F.sum(j[a] * r).alias(f"v{a}") for a in range(n)]).first()
        m = np.array([[sums[f"m{a}_{b}"] for b in range(n)] for a in range(n)])
        beta = (np.array(beta) + np.linalg.solve(m, np.array([sums[f"v{a}"] for a in range(n)]))).tolist()
    r = residual([F.lit(float(b)) for b in beta])
    return beta, float(rows.agg(F.sqrt(F.avg(r * r))).first()[0])


def norm_rows(x: Grid) -> DataFrame:
    return x.df.groupBy(*Axis.COL.keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
