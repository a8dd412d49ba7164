"""Factors in tiles against numpy."""

import numpy as np
import pytest

from arraymill.operators import factor, products
from arraymill.operators.blocks import BlockMatrix
from arraymill.operators.grid import Grid

RNG = np.random.default_rng(21)
A = RNG.normal(size=(11, 11))


def tiled(spark, m, side):
    return BlockMatrix.from_grid(Grid.local(spark, m.tolist()), side)


def dense(x):
    x = x if isinstance(x, Grid) else x.to_grid()
    out = np.full(x.shape, np.nan)
    for r in x.df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.mark.parametrize("side", [4, 20])
def test_factors_inverse_and_determinant(spark, side):
    made = factor.lu(tiled(spark, A, side))
    low, up = dense(made.lower), dense(made.upper)
    np.testing.assert_allclose(low @ up, A[made.rows], atol=1e-12)
    assert np.array_equal(low, np.tril(low)) and np.array_equal(up, np.triu(up)) and sorted(made.rows) == list(range(11))
    sign, log = made.determinant()
    np.testing.assert_allclose((sign, log), np.linalg.slogdet(A))
    b = RNG.normal(size=(11, 3))
    np.testing.assert_allclose(dense(made.solve(tiled(spark, b, side))), np.linalg.solve(A, b), atol=1e-10)
    np.testing.assert_allclose(dense(factor.inverse(tiled(spark, A, side))), np.linalg.inv(A), atol=1e-10)


def test_pivots_are_needed_or_refused(spark):
    m = np.array([[0.0, 1, 2], [1, 0, 3], [2, 1, 0]])
    made = factor.lu(tiled(spark, m, 2))
    np.testing.assert_allclose(dense(made.lower) @ dense(made.upper), m[made.rows], atol=1e-12)
    with pytest.raises(Exception, match="pivot"):
        factor.lu(tiled(spark, m, 2), pivot=False)
    own = A @ A.T + np.eye(11)
    plain = factor.lu(tiled(spark, own, 4), pivot=False)
    assert plain.rows == list(range(11))
    np.testing.assert_allclose(dense(plain.lower) @ dense(plain.upper), own, atol=1e-9)


@pytest.mark.parametrize("side", [4, 20])
def test_cholesky(spark, side):
    own = A @ A.T + np.eye(11)
    np.testing.assert_allclose(dense(factor.cholesky(tiled(spark, own, side))), np.linalg.cholesky(own), atol=1e-10)
    with pytest.raises(Exception, match="positive definite"):
        factor.cholesky(tiled(spark, -own, side))


@pytest.mark.parametrize("shape", [(9, 4), (4, 9), (5, 5)])
def test_singular_values_and_pseudo_inverses_of_grids(spark, shape):
    m = RNG.normal(size=shape)
    u, s, vt = (dense(g) for g in products.svd(Grid.local(spark, m.tolist())))
    np.testing.assert_allclose(s[0], np.linalg.svd(m)[1], rtol=1e-10)
    np.testing.assert_allclose(u * s @ vt, m, atol=1e-10)
    np.testing.assert_allclose(dense(products.pinv(Grid.local(spark, m.tolist()))), np.linalg.pinv(m), atol=1e-10)


def test_queries_of_factors_multiply_in_tiles(spark, monkeypatch):
    from arraymill.catalog import domains

    def none(*_):
        raise AssertionError("a row for each product of cells")

    monkeypatch.setattr(domains.products, "matmul", none)
    monkeypatch.setattr(domains.factor, "SIDES", (3,))
    for name in ("cholesky", "lu_decomposition", "pivotLU_decomposition"):
        assert domains.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 100


def test_tables_of_earlier_rounds_are_deleted(spark, tmp_path, monkeypatch):
    from arraymill.plans import cut as plans

    monkeypatch.setattr(plans, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    m = np.random.default_rng(3).normal(size=(20, 20))
    factor.lu(BlockMatrix.from_grid(Grid.local(spark, m.tolist()), 4))
    assert len(list((tmp_path / "arraymill").iterdir())) == 1


def bytes_of(spark, path):
    df = spark.read.parquet(path)
    return df.selectExpr("sum(length(data))").first()[0] or 0 if "data" in df.columns else 0


@pytest.mark.parametrize("kind", ["lu", "cholesky"])
def test_what_is_written_grows_slower_than_the_columns_of_tiles(spark, tmp_path, monkeypatch, kind):
    from pyspark.sql import DataFrameWriter

    from arraymill.plans import cut as plans

    monkeypatch.setattr(plans, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    own, sizes, n = DataFrameWriter.parquet, [], 24
    m = np.random.default_rng(4).normal(size=(n, n)) / 50 + np.eye(n)

    def parquet(self, path, *args, **kwargs):
        own(self, path, *args, **kwargs)
        sizes.append(bytes_of(spark, path))

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    x = BlockMatrix.from_grid(Grid.local(spark, (m if kind == "lu" else m @ m.T).tolist()), 2)
    made = factor.lu(x).upper if kind == "lu" else factor.cholesky(x)
    # 12 columns of tiles; each rewrote all of the matrix before
    assert sum(sizes) < 5 * 8 * n * n
    np.testing.assert_allclose(dense(made), np.triu(dense(made)) if kind == "lu" else np.linalg.cholesky(m @ m.T), atol=1e-10)


def test_pivots_of_a_diagonal_tile_need_no_tournament(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a tournament")

    m = A + 40 * np.eye(11)
    m[[0, 1]] = m[[1, 0]]
    own = factor._tournament
    monkeypatch.setattr(factor, "_tournament", none)
    made = factor.lu(tiled(spark, m, 4))
    np.testing.assert_allclose(dense(made.lower) @ dense(made.upper), m[made.rows], atol=1e-10)
    assert made.rows[:2] == [1, 0]
    met = []
    monkeypatch.setattr(factor, "_tournament", lambda *a: met.append(1) or own(*a))
    m[[0, 9]] = m[[9, 0]]
    made = factor.lu(tiled(spark, m, 4))
    np.testing.assert_allclose(dense(made.lower) @ dense(made.upper), m[made.rows], atol=1e-10)
    assert met


def test_many_passes_give_the_same(spark, monkeypatch):
    from arraymill.operators import blocks

    monkeypatch.setattr(blocks, "DEALT", 1)
    monkeypatch.setattr(blocks, "SQUARE", 1)
    passes, own = [], blocks.product
    monkeypatch.setattr(blocks, "product", lambda *a: passes.append(a[-1]) or own(*a))
    m = np.random.default_rng(6).normal(size=(14, 14))
    np.testing.assert_allclose(dense(factor.inverse(tiled(spark, m, 3))), np.linalg.inv(m), atol=1e-9)
    assert any(p and p[0] > 0 for p in passes)
    np.testing.assert_allclose(dense(factor.cholesky(tiled(spark, m @ m.T, 3))), np.linalg.cholesky(m @ m.T), atol=1e-9)


def test_what_a_table_shuffled_is_deleted_with_its_writing(spark, tmp_path, monkeypatch):
    from arraymill.plans import cut as plans

    monkeypatch.setattr(plans, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    context = spark.sparkContext._jsc.sc()
    kept = lambda: context.env().mapOutputTracker().shuffleStatuses().size()
    before, tables = kept(), plans.Tables(spark, "own")
    path = tables.write(spark.range(100).repartition(3, "id"))
    assert kept() <= before and tables.read("id long", path).count() == 100
    tables.drop(path)
    assert not list((tmp_path / "arraymill").glob("own-*/*"))


def test_a_matrix_without_rows(spark):
    none = BlockMatrix(spark.createDataFrame([], "brow long, bcol long, data binary"), 0, 0, 4)
    made = factor.lu(none)
    assert made.rows == [] and made.lower.df.count() == 0 and made.determinant() == (1.0, 0.0)
    assert factor.inverse(none).df.count() == 0 and factor.cholesky(none).df.count() == 0


def test_a_determinant_keeps_no_tiles_below_the_diagonal(spark, tmp_path, monkeypatch):
    from arraymill.plans import cut as plans

    monkeypatch.setattr(plans, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    for m in (A, A + 40 * np.eye(11)):
        made = factor.lu(tiled(spark, m, 3), lower=False)
        np.testing.assert_allclose(made.determinant(), np.linalg.slogdet(m))
        assert not made.below


def test_a_file_holds_as_many_tiles_as_a_reader_may_take_at_once(spark, tmp_path, monkeypatch):
    from arraymill.plans import cut as plans

    monkeypatch.setattr(plans, "checkpoint_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(factor, "READ", 3 * 8 * 4 * 4)
    factor.lu(tiled(spark, A, 4))
    files = list((tmp_path / "arraymill").rglob("*.parquet"))
    assert files and max(spark.read.parquet(f"file://{f}").count() for f in files) <= 3
