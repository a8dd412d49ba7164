"""Selection by rank and as-of joins against plain versions."""

import bisect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraymill.operators import order
from arraymill.operators.grid import Grid
from arraymill.plans.asof import bracket
from arraymill.plans.select import ranks


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(6)
    out = {"even": rng.uniform(size=3000).tolist(), "wide": (10.0 ** rng.uniform(-200, 200, 3000)).tolist(), "tied": [1.0] * 2500 + [2.0] * 500, "one": [4.0], "hot": rng.integers(0, 3, 3000).astype(float).tolist()}
    out |= {"signed": (rng.normal(size=1500) ** 3).tolist() + [-0.0, 0.0, float("inf"), float("-inf")], "nan": [float("nan")] * 5 + rng.normal(size=900).tolist(), None: [3.0, None, 1.0], "nulls": [None, None]}
    return out


@pytest.mark.parametrize("few", [40, 100_000])
def test_ranks_of_all_groups_at_once(spark, groups, few):
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double").repartition(5)
    wanted = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "most": lambda n: n - 1, "late": lambda n: F.floor(n * 0.97), "beyond": lambda n: n}
    got = {r["k"]: r for r in ranks(df, ["k"], "v", wanted, few=few).collect()}
    for k, own in groups.items():
        own = sorted((v for v in own if v is not None), key=lambda v: (math.isnan(v), v))
        if not own:
            assert k not in got
            continue
        n, at = len(own), got[k]
        for name, i in (("first", 0), ("mid", n // 2), ("most", n - 1), ("late", math.floor(n * 0.97))):
            assert at[name] == own[i] or (math.isnan(own[i]) and math.isnan(at[name])), (k, name)
        assert at["beyond"] is None
    whole = sorted(v for own in groups.values() for v in own if v is not None and not math.isnan(v))
    df = df.filter(~F.isnan("v"))
    assert ranks(df, [], "v", {"m": lambda n: F.floor(n / 3)}, few=few).collect() == [(whole[len(whole) // 3],)]
    assert ranks(df.filter("false"), ["k"], "v", {"m": lambda n: F.lit(0)}, few=few).collect() == []


@pytest.mark.parametrize(("mode", "method"), [("linear", "linear"), ("lower", "lower"), ("higher", "higher"), ("nearest", "nearest"), ("midpoint", "midpoint")])
def test_percentiles_like_numpy(spark, mode, method):
    v = np.random.default_rng(3).normal(size=(7, 40))
    got = order.percentile(Grid.local(spark, v.tolist()), 35, order.Axis.COL, mode).orderBy("row").toPandas()["value"]
    np.testing.assert_allclose(got, np.percentile(v, 35, axis=1, method=method), rtol=1e-12)


@pytest.mark.parametrize("partitions", [1, 7])
def test_brackets(spark, partitions):
    rng = np.random.default_rng(2)
    edges = [(k, float(x), i) for i, (k, x) in enumerate(zip(rng.choice(["a", "b", "c"], 60), rng.integers(0, 40, 60), strict=True))] + [("a", None, 90), ("a", float("nan"), 91), (None, 5.0, 92)]
    left = [(i, str(rng.choice(["a", "b", "c", "d"])), float(rng.integers(-3, 45)) + 0.5 * float(rng.integers(0, 2))) for i in range(300)] + [(300 + i, "b", 7.0) for i in range(400)]
    left += [(900, "a", None), (901, "b", float("nan")), (902, None, 6.0), (903, None, 4.0)]
    met = bracket(spark.createDataFrame(left, "id int, k string, x double").repartition(4), spark.createDataFrame(edges, "k string, x double, e int"), "x", ["k"], partitions)
    assert met.columns == ["id", "k", "x", "below", "above", "edges"]
    got = {r["id"]: (r["below"] and tuple(r["below"]), r["above"] and tuple(r["above"])) for r in met.collect()}
    for i, k, x in left:
        own = sorted((u, e) for g, u, e in edges if g == k and u is not None and not math.isnan(u))
        at = bisect.bisect_right(own, (x, 1e9)) if x is not None and not math.isnan(x) else None
        assert got[i] == (None, None) if at is None else got[i] == (own[at - 1] if at else None, own[at] if at < len(own) else None), (i, k, x)
    assert len(got) == len(left)


def test_bins_and_interpolation_with_edges_in_a_table(spark):
    rng = np.random.default_rng(8)
    v, e = rng.integers(0, 30, 500).astype(float), np.array([3.0, 3.0, 7.0, 12.0, 12.5, 20.0])
    x, edges = Grid.local(spark, v.tolist()), spark.createDataFrame([(float(i),) for i in e] + [(None,), (float("nan"),)], "edge double")
    got = order.digitize_by(x, edges).df.orderBy("col").toPandas()["value"]
    np.testing.assert_array_equal(got, np.digitize(v, np.unique(e)))
    table = order.histogram_by(x, edges).orderBy("bin").collect()
    np.testing.assert_array_equal([r["value"] for r in table], np.histogram(v, np.unique(e))[0])
    assert [(r["low"], r["high"]) for r in table] == list(zip(np.unique(e)[:-1], np.unique(e)[1:], strict=True))
    xp = np.unique(np.concatenate([[0.0, 29.0], rng.uniform(0, 29, 20)]))
    fp = rng.normal(size=len(xp))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xp, fp, strict=True)], "xp double, fp double")
    np.testing.assert_allclose(order.interp(x, points).df.orderBy("col").toPandas()["value"], np.interp(v, xp, fp), rtol=1e-12)
    with pytest.raises(Exception, match="outside"):
        order.interp(Grid.local(spark, [30.0]), points).df.collect()


def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch):
    from arraymill.plans import asof

    monkeypatch.setattr(asof, "RANGE_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "CAST(id AS double) AS at")
    edges = spark.range(0, 1000, 10).selectExpr("CAST(id AS double) AS at", "id AS edge")
    met = asof.bracket(rows, edges, "at")
    assert met.rdd.getNumPartitions() >= 20
    assert met.filter("below.edge <> id div 10 * 10 OR edges <> id div 10 + 1").count() == 0 and met.count() == 1000


def test_small_files_of_costly_rows_reach_all_tasks(spark):
    from arraymill.catalog import domains, special

    for queries, name in ((domains.QUERIES, "airy"), (special.QUERIES, "special_airy_bi")):
        assert queries[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
