import numpy as np
import pytest

from arraymill.llm import embedding_dedup


def brute_force(rows, threshold=0.93):
    units = [embedding_dedup.unit(v) if label is not None else None for _, label, v in rows]
    n = len(rows)

    def linked(i, j):
        a, b = units[i], units[j]
        return i != j and rows[i][1] == rows[j][1] and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold

    links = [[j for j in range(n) if linked(i, j)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        changed, label = new != label, new
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    ids = [least.get(label[i]) for i in range(n)]
    return sorted(((-1 if d is None else d), len(links[i]), -1 if ids[i] is None else ids[i], d == ids[i]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize(("cell", "block"), [(2000, 2048), (20, 2048), (40, 9)])
def test_agrees_with_brute_force(spark, cell, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((1000 - len(rows), int(g % 3), (centre + rng.normal(size=16) * 0.28).tolist()))
    rows += [(2000 + i, int(rng.integers(0, 3)), rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(3000, None, rows[0][2]), (3001, 0, None), (3002, 0, [0.0] * 16), (3003, 0, [float("nan")] * 16), (3004, 0, [None] + [1.0] * 15), (3005, 0, []), (3006, rows[0][1], rows[0][2][:8]), (None, rows[0][1], rows[0][2]), (1000, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, row string").repartition(3)
    got = embedding_dedup.links(docs, cell=cell, block=block).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, bool(r.kept)) for r in got) == brute_force(rows)


def test_levels_of_cells_and_equal_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 1, rng.normal(size=3).tolist()) for i in range(900)]
    one = [0.25, -1.5, 3.0]
    rows += [(10_000 + i, 2, one) for i in range(5000)]
    nodes = spark.createDataFrame([(1, 3, i, 1, bytearray(embedding_dedup.unit(v).tobytes())) for i, _, v in rows[:900]], "label int, dim int, node long, m long, unit binary")
    depth = {len(r.trail) for r in embedding_dedup.cells(nodes, 0.999, 600, 4, 2048).collect()}
    assert max(depth) > 1
    got = {r.vec_id: r for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0.999, 600, 4).collect()}
    assert all(got[10_000 + i].n_links == 4999 and got[10_000 + i].component_id == 10_000 for i in range(5000))
    assert sorted((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got.values() if r.vec_id < 900) == brute_force(rows[:900], 0.999)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embedding_dedup.links(docs).count() == 0
    assert embedding_dedup.representatives(docs).count() == 0
