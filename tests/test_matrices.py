"""Tiled products and orthogonal factors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import blocks, products, tall
from arraymill.operators.blocks import BlockMatrix
from arraymill.operators.grid import Grid

RNG = np.random.default_rng(12)


def tiled(spark, m, side):
    return BlockMatrix.from_grid(Grid.local(spark, m.tolist()), side)


def dense(x):
    out = np.full(x.shape, -99.0)
    for r in x.to_grid().df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.mark.parametrize("side", [3, 4, 100])
def test_products(spark, side):
    a, b, c = RNG.normal(size=(7, 10)), RNG.normal(size=(10, 5)), RNG.normal(size=(5, 8))
    x, y, z = (tiled(spark, m, side) for m in (a, b, c))
    np.testing.assert_allclose(dense(x.multiply(y)), a @ b)
    np.testing.assert_allclose(dense(x.transpose()), a.T)
    np.testing.assert_allclose(dense(x.gram()), a.T @ a)
    np.testing.assert_allclose(dense(x.covariance()), np.cov(a, rowvar=False))
    np.testing.assert_allclose(dense(blocks.chain([x, y, z])), a @ b @ c)
    square = tiled(spark, a[:, :7], side)
    np.testing.assert_allclose(dense(blocks.power(square, 5)), np.linalg.matrix_power(a[:, :7], 5))
    np.testing.assert_array_equal(dense(blocks.power(square, 0)), np.eye(7))
    with pytest.raises(ValueError, match="inner"):
        y.multiply(x)


def test_zeros_meet_non_finite_values_and_absent_cells_are_zeros(spark):
    a, b = np.zeros((5, 5)), RNG.normal(size=(5, 4))
    a[0, 3], b[1, 0], b[2, 2] = np.nan, np.inf, np.nan
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(np.isnan(dense(tiled(spark, a, 2).multiply(tiled(spark, b, 2)))), np.isnan(a @ b))
    sparse = Grid(spark.createDataFrame([(4, 0, 2.0)], "row long, col long, value double"), 5, 3)
    want = np.zeros((5, 3))
    want[4, 0] = 2
    np.testing.assert_array_equal(dense(BlockMatrix.from_grid(sparse, 2)), want)
    stored = products.matmul(Grid.local(spark, [[0.0, 1.0]]), Grid.local(spark, [[float("inf")], [1.0]])).df.first()["value"]
    assert np.isnan(stored)


def test_rows_as_vectors(spark):
    m = RNG.normal(size=(11, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "at long, v array<double>").repartition(4)
    x = BlockMatrix.from_vectors(df, F.col("at"), F.col("v"), 11, 6, side=4)
    np.testing.assert_allclose(dense(x.multiply(x.transpose())), m @ m.T)
    with pytest.raises(Exception, match="missing"):
        BlockMatrix.from_vectors(df.filter("at <> 2"), F.col("at"), F.col("v"), 11, 6, side=4).df.collect()


def test_least_squares_of_nearly_dependent_columns(spark, monkeypatch):
    monkeypatch.setattr(tall, "FAN_IN", 2)
    monkeypatch.setattr(tall, "BLOCK", 30)
    n = 400
    q, d = RNG.normal(size=n) + 5, RNG.normal(size=n)
    y = 1 + 2 * q + 3 * (q + 1e-7 * d)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(q, q + 1e-7 * d, y, y + 2 * d, strict=True)], "a double, b double, y double, z double").repartition(9)
    c, residual = tall.lstsq(rows, [F.lit(1.0), F.col("a"), F.col("b")], [F.col("y"), F.col("z")])
    np.testing.assert_allclose(c[:, 0], [1, 2, 3], atol=1e-6)
    np.testing.assert_allclose(residual, 0, atol=1e-5)
    both = np.column_stack([q, q + 1e-7 * d, y])
    s, vt = tall.singular_values(rows, F.col("a"), F.col("b"), F.col("y"))
    np.testing.assert_allclose(s[:2], np.linalg.svd(both)[1][:2], rtol=1e-9)
    left, s, vt = tall.svd(rows, [F.col("a"), F.col("z")])
    u = left.select("u0", "u1", "a", "z").toPandas().to_numpy()
    np.testing.assert_allclose(u[:, :2].T @ u[:, :2], np.eye(2), atol=1e-9)
    np.testing.assert_allclose(u[:, :2] * s @ vt, u[:, 2:], atol=1e-9)


def test_short_dependent_and_empty_systems(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 1.0, 1.0)], "a double, b double, y double")
    c, _ = tall.lstsq(rows, [F.col("a"), F.col("b")], [F.col("y")])
    assert abs(c[0, 0] + 2 * c[1, 0] - 3) < 1e-12
    assert (tall.triangle(rows.limit(0), F.col("a"), F.col("b")) == 0).all()
    a, b = RNG.normal(size=(20, 3)), RNG.normal(size=(20, 2))
    got = products.lstsq(Grid.local(spark, a.tolist()), Grid.local(spark, b.tolist()))
    np.testing.assert_allclose(got, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-12)


def test_covariance_and_correlation_of_grids(spark):
    m = RNG.normal(size=(4, 9))
    x = Grid.local(spark, m.tolist())
    table = lambda g: g.df.orderBy("row", "col").toPandas()["value"].to_numpy().reshape(4, 4)
    np.testing.assert_allclose(table(products.cov(x)), np.cov(m))
    np.testing.assert_allclose(table(products.corrcoef(x)), np.corrcoef(m))
    np.testing.assert_allclose(table(products.multi_dot([x, Grid.local(spark, m.T.tolist())])), m @ m.T)


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_products_shuffle_no_tiles_of_the_result(spark, monkeypatch, held):
    def none(parts):
        raise AssertionError("tiles of the result are shuffled")

    monkeypatch.setattr(blocks, "_added", none)
    monkeypatch.setattr(blocks, "HELD", held)
    monkeypatch.setattr(blocks, "SQUARE", held)
    rng = np.random.default_rng(5)
    for rows, inner, cols in ((9, 3, 14), (9, 11, 14)):
        a, b = rng.normal(size=(rows, inner)), rng.normal(size=(inner, cols))
        x, y = (BlockMatrix.from_grid(Grid.local(spark, m.tolist()), 4) for m in (a, b))
        made = {(r["row"], r["col"]): r["value"] for r in x.multiply(y).to_grid().df.collect()}
        assert len(made) == rows * cols
        assert all(abs(made[i, j] - (a @ b)[i, j]) < 1e-12 for i in range(rows) for j in range(cols))


def test_cells_of_a_product_leave_the_worker_that_made_them(spark):
    a, b = RNG.normal(size=(7, 10)), RNG.normal(size=(10, 5))
    made = tiled(spark, a, 3).multiply(tiled(spark, b, 3))
    alone, plan = (x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for x in (made.df, made.to_grid().df))
    # tiles went to Spark and came back in a second worker
    assert plan == alone
    np.testing.assert_allclose(dense(made), a @ b)


def test_products_of_triangles_and_sums(spark):
    low = np.tril(RNG.normal(size=(9, 9)))
    x = tiled(spark, low, 2)
    np.testing.assert_allclose(dense(x.multiply(x.transpose())), low @ low.T, atol=1e-12)
    own = spark.createDataFrame([(i, float(i)) for i in range(9)], "at long, value double")
    np.testing.assert_allclose(dense(x.multiply(x, plus=BlockMatrix.diagonal(own, 9, 2).df)), low @ low + np.diag(np.arange(9.0)), atol=1e-12)
    lower = x.multiply(x.transpose(), lower=True)
    assert {(r["brow"], r["bcol"]) for r in lower.df.collect()} == {(i, j) for i in range(5) for j in range(i + 1)}


def test_tiles_are_dealt_to_as_few_squares_as_keep_the_cores_busy(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        x = BlockMatrix(spark.range(20).selectExpr("id as brow", "0L as bcol", "unhex(repeat('00', 8)) as data"), 20, 1, 1)
        squares = x.multiply(x.transpose()).df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # 400 before, with each tile dealt 20 times
    assert squares <= 4 * spark.sparkContext.defaultParallelism
