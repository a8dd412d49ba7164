import hashlib
from collections import Counter

import numpy as np
import pytest

from arraymill.llm import suffix_dedup


def brute_force(rows, min_len):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + min_len] for t in texts for i in range(len(t) - min_len + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - min_len + 1):
            if n[t[i : i + min_len]] > 1:
                gone[i + 1 : i + 1 + min_len] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(t, gone[1:], strict=False) if not g)
        out.append((-1 if d is None else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture(min_len):
    rng = np.random.default_rng(min_len)
    words = ["alpha", "be", "γάμμα", "d", "epsilon", "zeta-eta", "\n"]
    make = lambda n: " ".join(rng.choice(words + [f"x{rng.integers(0, 10**6)}" for _ in range(200)], n))
    shared = [make(n) for n in (min_len // 5, min_len // 3, min_len)]
    rows = []
    for i in range(40):
        parts = [make(int(rng.integers(1, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, 3))][int(rng.integers(0, 20)) :], make(int(rng.integers(1, 40)))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[7][1]), (101, rows[7][1]), (None, rows[9][1][: min_len + 3]), (102, None), (103, ""), (104, "ab" * min_len), (105, "z" * (min_len + 1)), (106, "z" * min_len), (107, "q" * (min_len - 1))]
    return rows


@pytest.mark.parametrize(("min_len", "limit"), [(400, 4096), (40, 4096), (40, 2), (150, 4096)])
def test_agrees_with_brute_force(spark, min_len, limit):
    rows = fixture(min_len)
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, low int").repartition(3)
    got = suffix_dedup.removed(table, min_len, limit).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows, min_len)


@pytest.mark.parametrize("min_len", [1, 3, 8, 30])
def test_backward_extension(min_len):
    rng = np.random.default_rng(min_len)
    for _ in range(20):
        s = rng.integers(1, 4, int(rng.integers(min_len + 2, 200))).astype(np.int16)
        if rng.random() < 0.5:
            s[len(s) // 2 :] = s[: len(s) - len(s) // 2]
        s[-1] = 0
        ring = np.concatenate([s, s])
        n = Counter(ring[i : i + min_len].tobytes() for i in range(len(s)))
        assert suffix_dedup.repeats(s, min_len).tolist() == [n[ring[i : i + min_len].tobytes()] > 1 for i in range(len(s))]


def test_empty_table(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
