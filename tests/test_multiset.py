"""Sets that keep repeats, updates of grids, and draws that belong to rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.functions import numeric
from arraymill.operators import layout, multiset
from arraymill.operators.grid import Grid, Slice
from arraymill.operators.random import RNG


@pytest.mark.parametrize("piece", [3, 1 << 16])
def test_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(multiset, "PIECE", piece)
    a, b = [1.0] * 17 + [2.0, 3.0, 3.0], [1.0] * 4 + [3.0, 5.0, 5.0, 5.0]
    x, y = Grid.local(spark, a), Grid.local(spark, b)
    p, q = Counter(a), Counter(b)
    for f, want in ((multiset.set_union, p | q), (multiset.set_intersection, p & q), (multiset.set_difference, p - q), (multiset.set_symmetric_difference, (p - q) + (q - p)), (multiset.merge, p + q)):
        out = f(x, y)
        rows = out.df.orderBy("col").collect()
        assert [r["value"] for r in rows] == sorted(want.elements()) and [r["col"] for r in rows] == list(range(out.size))
    none = multiset.set_difference(x, x)
    assert none.size == 0 and none.df.count() == 0
    assert multiset.minmax_element(Grid.local(spark, [[2.0, 1.0], [1.0, 2.0]])).collect() == [(1, 3)]


def test_updates(spark):
    x, y = Grid.local(spark, [[1.0, -2.0], [3.0, -4.0]]), Grid.local(spark, [[9.0, 8.0], [7.0, 6.0]])
    table = lambda g: np.array([r["value"] for r in g.df.orderBy("row", "col").collect()]).reshape(g.shape)
    np.testing.assert_array_equal(table(layout.copyto(x, y)), [[9, 8], [7, 6]])
    np.testing.assert_array_equal(table(layout.copyto(x, y, x < 0)), [[1, 8], [3, 6]])
    np.testing.assert_array_equal(table(layout.copyto(x, 0.5)), [[0.5, 0.5], [0.5, 0.5]])
    assert layout.resize_fast(x, 3, 1).shape == (3, 1) and layout.alen(x) == 2 and layout.swap(x, y) == (y, x)
    assert Slice(5, 1, -2).to_indices(6) == [1, 3] and Slice(0, -1, 2).to_indices(6) == [0, 2, 4]
    info = numeric.dtype_info("uint16")
    assert (info["bits"], info["is_signed"], info["max"]) == (16, False, 65535) and numeric.dtype_info("double")["epsilon"] == 2.0**-52


def test_draws_follow_the_row(spark):
    rows = spark.range(4000).withColumn("k", F.col("id") * 7)
    draws = lambda df: df.select("id", *[d.alias(f"d{i}") for i, d in enumerate((lambda g: (g.rand(), g.randn(), g.gamma(0.5), g.beta(2, 3), g.poisson(600), g.binomial(2000, 0.4), g.discrete([1, 2]), g.non_central_chi_squared(2, 3)))(RNG(3, "k")))])
    whole = {r["id"]: tuple(r) for r in draws(rows).collect()}
    some = draws(rows.filter("id % 3 = 1").repartition(7)).collect()
    assert all(whole[r["id"]] == tuple(r) for r in some)
    table = np.array([v[1:] for v in whole.values()], float)
    want = [(0.5, 1 / 12), (0, 1), (0.5, 0.5), (0.4, 0.04), (600, 600), (800, 480), (2 / 3, 2 / 9), (5, 16)]
    for values, (mean, variance) in zip(table.T, want, strict=True):
        assert abs(values.mean() - mean) < 6 * (variance / len(values)) ** 0.5 and abs(values.var() / variance - 1) < 0.3
    free = spark.range(4000).select(RNG(1).gamma(2.0).alias("g"), RNG(9).student_t(9).alias("t")).agg(F.avg("g"), F.avg("t")).first()
    assert abs(free[0] - 2) < 0.2 and abs(free[1]) < 0.2
