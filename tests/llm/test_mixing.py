import numpy as np
import pytest

from arraymill.llm import mixing


def water_filling(sizes):
    """Targets by the rule as stated: share by weight, stop at the caps, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        aim = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if aim[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **aim}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def documents(spark, rng):
    rows = []
    for s, n in (("b", 900), ("a", 30), (None, 50), ("é", 200), ("c", 5)):
        rows += [(len(rows) + i, "w x " * int(rng.integers(0, 40)), s, 1.5) for i in range(n)]
    rows += [(None, None, "a", 0.0), (7, "same row", "b", 0.0), (7, "same row", "b", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size double")


def test_targets_words_and_reruns(spark):
    docs = documents(spark, np.random.default_rng(1))
    got = mixing.mix(docs, block=64).toPandas()
    sizes = {(s if isinstance(s, str) else None): int(x["size"].sum()) for s, x in got.groupby("source", dropna=False)}
    assert len(got) == docs.count()
    for s, target in water_filling(sizes).items():
        rows = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert (rows["source_size"] == sizes[s]).all()
        assert np.allclose(rows["target"], target)
        assert abs(rows["taken"].sum() - target) <= rows["size"].max() + 1e-6
    assert (got["taken"] == got["copies"] * got["size"]).all() and (got["copies"] <= 3).all()
    again = mixing.mix(docs.repartition(5), block=64).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(order)["taken"].tolist() == again.sort_values(order)["taken"].tolist()
    out = mixing.mixed(docs, block=64)
    assert out.columns == docs.columns
    assert out.count() == got["copies"].sum()


@pytest.mark.parametrize("seed", range(3))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    pi, size = rng.random(500), rng.integers(1, 5000, 500).astype(float)
    out = mixing.flight(pi, size)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6
    assert abs((out * size).sum() - (pi * size).sum()) < 1e-3


def test_targets_are_met_beside_large_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60) if i % 25 else 4000), f"s{i % 5}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 60


def test_rows_that_repeat_share_copies(spark):
    rows = [(1, "one two three", "a")] * 7 + [(2, "w " * 100, "b"), (3, "w " * 90, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    own = got[got["doc_id"] == 1]
    assert len(got) == 9 and own["copies"].max() - own["copies"].min() <= 1 and own["copies"].max() <= 3


def test_empty_table(spark):
    docs = documents(spark, np.random.default_rng(1)).limit(0)
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
