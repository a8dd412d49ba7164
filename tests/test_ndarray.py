"""Arrays of any rank against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.functions import reducers
from arraymill.operators import ndarray
from arraymill.operators.grid import Slice
from arraymill.operators.ndarray import NDArray

SHAPE = (3, 4, 2, 5)
V = np.random.default_rng(1).permutation(120).reshape(SHAPE).astype(float)


def array(spark, values, order):
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(values)]
    names = [f"i{k}" for k in range(values.ndim)]
    return NDArray.of(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", value double"), values.shape, *names, order=order)


def values(a):
    out = np.full(a.size, np.nan)
    for r in a.df.collect():
        out[r["at"]] = r["value"]
    return out.reshape(a.shape, order=a.order)


@pytest.mark.parametrize("order", ndarray.ORDERS)
def test_layout_and_reductions(spark, order):
    a = array(spark, V, order)
    same = lambda x, want: np.testing.assert_array_equal(values(x), want)
    same(a, V)
    same(a.reshape(6, -1), V.reshape((6, 20), order=order))
    same(a.flatten(), V.ravel(order))
    same(a.reordered("C" if order == "F" else "F"), V)
    same(a.with_order("C" if order == "F" else "F"), V.T)
    same(a.transpose(2, 0, 3, 1), V.transpose(2, 0, 3, 1))
    same(a.swapaxes(0, 3), V.swapaxes(0, 3))
    same(a.expand_dims(1).squeeze(), V)
    same(a.flip((0, -1)), V[::-1, :, :, ::-1])
    same(a.roll(-7, 1), np.roll(V, -7, 1))
    same(a.slice(None, Slice(1, 4, 2), None, Slice(-4, -1)), V[:, 1:4:2, :, -4:-1])
    for axes in (None, 0, (1, 3), (0, 1, 2), -1):
        named = axes if axes is None or isinstance(axes, int) else tuple(axes)
        same(a.reduce(reducers.sum_, axes), V.sum(axis=named))
        same(a.reduce(reducers.amax, axes, keep=True), V.max(axis=named, keepdims=True))
    same(a.arg_extreme(2), V.argmax(2))
    same(a.arg_extreme(None, largest=False), V.ravel(order).argmin())
    same(a.cumulative(F.sum, 1), V.cumsum(1))
    assert a.at(1, -1, 0, 2).first()[0] == V[1, -1, 0, 2] and a.front().first()[0] == V[0, 0, 0, 0] and a.back().first()[0] == V[-1, -1, -1, -1]


@pytest.mark.parametrize("order", ndarray.ORDERS)
def test_broadcasting_and_joining(spark, order):
    a, w = array(spark, V, order), V[0, :, :, :1]
    b = array(spark, w, "C")
    same = lambda x, want: np.testing.assert_array_equal(values(x), want)
    same(a - b, V - w)
    same(b - a, w - V)
    same(array(spark, V[:, :1, :1, :1], order) + array(spark, w, order), V[:, :1, :1, :1] + w)
    same(2 * a + 1 - (3 - a), 2 * V + 1 - (3 - V))
    same(ndarray.tmin(a, b.broadcast_to(*SHAPE), 50.0), np.minimum(np.minimum(V, w), 50))
    same(ndarray.tproduct(a, 2.0, a), V * 2 * V)
    x, y, z = (np.arange(n) * 10.0**n for n in (2, 3, 4))
    for made, want in zip(ndarray.meshgrid([array(spark, v, order) for v in (x, y, z)]), np.meshgrid(x, y, z, indexing="ij"), strict=True):
        same(made, want)
    same(ndarray.concatenate([a, a.flip(0)], 2), np.concatenate([V, V[::-1]], 2))
    same(ndarray.vstack([array(spark, x, order)] * 2), np.vstack([x, x]))
    same(ndarray.hstack([array(spark, x, order), array(spark, y, order)]), np.hstack([x, y]))
    plane = V[:, :, 0, 0]
    same(ndarray.dstack([array(spark, plane, order), array(spark, -plane, order)]), np.dstack([plane, -plane]))
    with pytest.raises(ValueError, match="broadcast"):
        a + array(spark, np.zeros(3), order)


def test_constants_diagonals_and_gaps(spark):
    ones = ndarray.ones(spark, (2, 3, 4))
    np.testing.assert_array_equal(values(ones), np.ones((2, 3, 4)))
    assert np.isnan(values(ndarray.empty(spark, (2, 2, 2))).astype(float)).all()
    np.testing.assert_array_equal(values(ndarray.diag(spark, 3.0, (2, 2, 2))), 3.0 * np.array([[[1, 0], [0, 0]], [[0, 0], [0, 1]]]))
    own = NDArray.of(spark.createDataFrame([(0, 1.41), (1, 2.16), (2, 3.14)], "i long, value double"), (3,), "i")
    np.testing.assert_array_equal(values(ndarray.diagonal_matrix(own, 1)), [[0, 2.16, 0], [0, 0, 3.14], [0, 0, 0]])
    np.testing.assert_array_equal(values(ndarray.diagonal_matrix(own, -1)), [[0, 0, 0], [1.41, 0, 0], [0, 2.16, 0]])
    gaps = NDArray.of(spark.createDataFrame([(0, 1, 5.0)], "i long, j long, value double"), (2, 2), "i", "j", order="C")
    np.testing.assert_array_equal(values(gaps.filled()), [[0, 5], [0, 0]])
    np.testing.assert_array_equal(values(NDArray.from_grid(gaps.to_grid()).filled(1.0)), [[1, 5], [1, 1]])
    table = spark.createDataFrame([("b", None, 1.0), ("a", 2, 2.0), ("b", None, 4.0)], "k string, n int, v double")
    made, labels = ndarray.from_table(table, {"k": F.col("k"), "n": F.col("n")}, F.sum("v"), "C")
    assert made.shape == (2, 2) and [[r["label"] for r in x.orderBy("index").collect()] for x in labels] == [["a", "b"], [None, 2]]
    np.testing.assert_array_equal(values(made.filled()), [[0, 2], [5, 0]])
    empty, _ = ndarray.from_table(table.limit(0), {"k": F.col("k")}, F.sum("v"))
    assert empty.shape == (0,) and empty.df.count() == 0 and empty.reduce(reducers.sum_).df.count() == 0
