import tracemalloc

import numpy as np
import pytest

from arraymill.llm import components, ngram_join


def plain_shingles(text, width=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(1, len(words))))}


def brute_force(rows, threshold=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    n = len(rows)
    links = [[bool(sets[i]) and bool(sets[j]) and i != j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if links[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return sorted(((-1 if d is None else d), -1 if least.get(label[i]) is None else least[label[i]], sum(links[i])) for i, (d, _) in enumerate(rows))


def fixture(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for n in (60, 200, 30, 400):
        base = rng.choice(vocabulary, n).tolist()
        for k in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 25)))):
                words[int(rng.integers(0, n))] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
            if k % 9 == 0:
                rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary, 50))) for i in range(40)]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "two words"), (903, "two words"), (904, "words two"), (905, "a\nb  c"), (906, "a b c"), (905, "a\nb  c")]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_agrees_with_brute_force(spark, block):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    got = ngram_join.join(docs, block=block).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == brute_force(rows)
    left = ngram_join.distinct_documents(docs, block=block)
    assert left.columns == docs.columns
    found = sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect())
    heads = sorted({-1 if r.doc_id is None else r.doc_id for r in got if r.kept})
    assert found == heads
    assert {900, 901} <= set(found)


def test_overlaps_and_pruning_table():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(20)]
    assert ngram_join.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    fewest = ngram_join.fewest_matches()
    assert fewest == sorted(fewest) and all(0 < m < 0.8 * 16 * (k + 1) for k, m in enumerate(fewest))


def test_components_of_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0
    assert ngram_join.distinct_documents(docs).count() == 0


def test_signatures_hold_little_memory_at_once():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 2000)).encode() for _ in range(250)]
    ngram_join.signatures(texts[:40])
    tracemalloc.start()
    node, size, _ = ngram_join.signatures(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert size.tolist() == [1996] * 250 and len(set(node.tolist())) == 250
    assert peak < 60, peak
