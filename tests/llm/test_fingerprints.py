import hashlib

import numpy as np
import pytest

from arraymill.llm import fingerprints
from arraymill.llm.shingles import shingle_hashes


def plain_shingles(text, width=5):
    words = text.encode().split()
    return [tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(1, len(words))))]


def test_shingles_agree_with_plain_ones():
    texts = ["a b c d e f a b c d e", "", "one", "one", "  x\ty\n z ", "ü ö ä ß é f", "a b c d e"]
    hashes, offset = shingle_hashes([t.encode() for t in texts])
    plain = [s for t in texts for s in plain_shingles(t)]
    assert np.diff(offset).tolist() == [len(plain_shingles(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(plain))
    assert len({(h, s) for h, s in zip(hashes.tolist(), plain)}) == len(set(plain))


def plain_likeness(a, b):
    """From all shingles' hashes of two texts, by the definition of sketches."""
    (x, y), most = ([set((shingle_hashes([t.encode()])[0] >> np.uint64(16)).tolist()) for t in (a, b)]), 2**45
    kept = {h for h in x if h < most}
    kept = x if len(kept) < fingerprints.FEW else kept
    return float(not y) if not kept else len(kept & y) / len(kept)


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_next_document_and_edit(spark, partitions):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, n)) for n in (400, 3, 900, 50, 1, 700, 60_000)]
    rows = [(3 * i, t, 0) for i, t in enumerate(texts)] + [(None, "null id here and more words", 1), (100, None, 2), (101, "", 3), (102, texts[2], 4), (102, texts[2], 5), (103, texts[2] + " and more", 6), (104, " ".join(texts[3].split()[:9]), 7), (105, texts[3], 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    got = fingerprints.compared(docs, partitions=partitions).toPandas()
    order = sorted(((-1 if i is None else i), t or "") for i, t, _ in rows)
    expected = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(t, e), 9), round(plain_likeness(t, after), 9)))
    got["id"] = got["doc_id"].fillna(-1).astype(int)
    got[["near_edited", "near_next"]] = got[["near_edited", "near_next"]].round(9)
    assert sorted(got[["id", "n_chars", "edited_sha256", "near_edited", "near_next"]].itertuples(index=False, name=None)) == sorted(expected)
    # a short text that the next one holds as a whole
    assert got.set_index("id")["near_next"][104] == 1
    for r in got.itertuples():
        own = {int(h) for t in {t for i, t in order if i == r.id} for h in shingle_hashes([t.encode()])[0] >> np.uint64(16)}
        digits = r.fingerprint.removeprefix(fingerprints.ALL)
        kept = [int(digits[k : k + 12], 16) for k in range(0, len(digits), 12)]
        below = sorted(h for h in own if h < 2**45)
        assert kept == (sorted(own) if len(below) < fingerprints.FEW else below)
        assert r.fingerprint.startswith(fingerprints.ALL) == (0 < len(kept) == len(own))


def test_ids_that_are_text(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, "four")], "doc_id string, text string")
    assert [(r.doc_id, r.n_chars) for r in sorted(fingerprints.compared(docs).collect(), key=lambda r: r.n_chars)] == [(None, 4), ("a", 5), ("b", 7)]


def test_full_fraction_is_exact_and_merges():
    a, b = (set(range(x, x + 300)) for x in (0, 200))
    ta, tb = (" ".join(f"t{i}" for i in sorted(s)).encode() for s in (a, b))
    (sa, _), (sb, _) = fingerprints.sketches([ta, tb], fraction=1.0)
    assert fingerprints.containment(sa, sb) == 96 / 296 == fingerprints.containment(sb, sa)
    assert len(fingerprints.union(sa, sb)) == 296 * 2 - 96


def test_sketches_of_any_sizes_merge():
    texts = [" ".join(f"{c}{i}" for i in range(n)).encode() for c, n in (("a", 20), ("b", 2000), ("c", 12))]
    (a, _), (b, every), (c, _) = fingerprints.sketches(texts)
    assert a.all and c.all and not b.all
    assert len(fingerprints.union(a, c)) == 16 + 8 and fingerprints.union(a, c).all
    joined = fingerprints.union(a, b)
    assert set(joined.hashes.tolist()) == set(a.below().tolist()) | set(b.hashes.tolist())
    (part, _), = fingerprints.sketches([b" ".join(texts[1].split()[:15])])
    assert fingerprints.containment(part, b, every) == 1 and fingerprints.containment(b, joined) == 1


def test_empty_table(spark):
    assert fingerprints.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fingerprints.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().fingerprint == ""
