import math
from fractions import Fraction

import numpy as np
import pytest

from arraymill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def plain(rows):
    """Numbers of each usable vector, deviations by fractions, components by the whole covariance."""
    own = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in own], dtype=object)
    n, s = len(own), x.sum(axis=0)
    apart = n * x - s
    centred = np.array([[float(Fraction(int(c), n)) for c in r] for r in apart])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [k for k, _ in own], [int((r * r).sum()) for r in apart], centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values


def agree(got, rows, components):
    keys, deviation, projected, values = plain(rows)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, components + 1))
    for j, own in by.items():
        assert sorted((r["vec_id"], r["deviation"], r["n"]) for r in own) == sorted(zip(keys, deviation, [len(keys)] * len(keys), strict=True))
        want = dict(zip(keys, projected[:, j - 1], strict=True))
        sign = np.sign(sum(r["whitened"] * want[r["vec_id"]] for r in own))
        assert max(abs(sign * r["whitened"] - want[r["vec_id"]]) for r in own) < 1e-8
        assert {r["explained"] for r in own} == {own[0]["explained"]} and abs(own[0]["explained"] / (values[j - 1] / values.sum()) - 1) < 1e-8
        assert own[0]["identity_error"] < 1e-9


@pytest.mark.parametrize(("decay", "expanded"), [(0.4, False), (0.95, True)])
def test_agrees_with_the_whole_covariance(spark, decay, expanded):
    """Where the spectrum falls fast the range finder does, else the full dimension."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(900, 40)) * 40 * decay ** np.arange(40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 3)]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 40), (2003, [None] + [1.0] * 39), (2004, [float("-inf")] + [1.0] * 39)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert whitening.fit(df).expanded is expanded
    out = whitening.whitened(df)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    agree(out.collect(), rows, 8)


def test_few_vectors_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [4.0, 0.0, 1.0]), (3, [2.5, -1.0, 7.0])]
    agree(whitening.whitened(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect(), rows, 2)
    twice = spark.createDataFrame([(k, v, None, None, None) for k, v in [*rows, *rows, (None, rows[0][1])]], SCHEMA)
    got = whitening.whitened(twice).collect()
    assert len(got) == 14 and {r["n"] for r in got} == {7} and sum(r["vec_id"] is None for r in got) == 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_spread_no_rows(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert whitening.whitened(df).collect() == []


def test_lengths_that_differ_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "", ""), (2, [1.0], 0, "", "")], SCHEMA)
    with pytest.raises(Exception, match="entries, not"):
        whitening.whitened(df)


def test_deviations_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(i, [float(i * 2**30), 0.0], 0, "", "") for i in range(4)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened(df).collect()
