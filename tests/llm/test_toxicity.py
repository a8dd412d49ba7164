import math
import zlib

import numpy as np
import pytest

from arraymill.llm import toxicity

BAD = ["grobnak", "vilthor", "zurmekk"]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9)))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        own = rng.choice(words, int(rng.integers(5, 120))).tolist()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(1, len(own) // 30)):
                own.insert(int(rng.integers(0, len(own))), str(rng.choice(BAD)) + str(rng.choice(["", "i", "an"])))
        docs.append((i, " ".join(own)))
        if i % 3:
            labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, toxic double").repartition(3)
    got = toxicity.rated(spark, table, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    truth = {i: int(i % 5 == 0) for i, _ in docs}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    assert ((got["predicted"] == 1) == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    right = (held["predicted"] == held["doc_id"].map(truth)).mean()
    assert right > 0.95


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame(docs[:300], "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (toxicity.rated(spark, table, spark.createDataFrame(x, "doc_id long, toxic int")).toPandas().sort_values("doc_id")["score"].tolist() for x in (labels, turned))
    assert np.allclose(a, b)


def test_edges(spark, corpus):
    docs, labels = corpus
    rows = [*docs[:200], (None, None), (5000, ""), (5000, ""), (5001, "grobnak " * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(table, known)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5001 not in ids and ids.count(5000) == 2 and None in ids
    none = toxicity.rated(spark, table, known.limit(0)).toPandas()
    assert (none["score"] == 0).all()
    assert toxicity.rated(spark, table.limit(0), known).count() == 0


def plain_grams(text):
    """The six bytes that end at each byte of each word and at the blank after it, zeros before the word's own blank."""
    plain = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    for word in plain.split(b" "):
        if word:
            data = b"\0" * 5 + b" " + word + b" "
            yield word, [data[i - 5 : i + 1] for i in range(6, len(data))]


def plain_counts(rows):
    """all, toxic, ordinary by gram, from rows of text and class."""
    counts = {}
    for text, kind in rows:
        for _, own in plain_grams(text):
            for g in own:
                c = counts.setdefault(g, [0, 0, 0])
                c[0] += 1
                if kind is not None:
                    c[2 - kind] += 1
    return counts


def plain_gains(counts, discount=toxicity.DISCOUNT, mass=toxicity.SHARED_MASS):
    """Gains by gram, straight from the definition of the models."""
    orders = {6: counts}
    for n in range(5, 0, -1):
        orders[n] = {}
        for g, c in orders[n + 1].items():
            own = orders[n].setdefault(g[1:], [0, 0, 0])
            for i in range(3):
                own[i] += c[i] if g[0] == 0 else int(c[i] > 0)

    def chance(g, which):
        n = len(g)
        beside = [c for o, c in orders[n].items() if o[:-1] == g[:-1]]
        sums, kinds = sum(c[which] for c in beside), sum(c[which] > 0 for c in beside)
        low = chance(g[1:], which) if n > 1 else toxicity.EVEN
        left = max(orders[n][g][which] - discount, 0)
        if which == 0:
            return (left + discount * kinds * low) / sums
        return (left + (discount * kinds + mass) * (low + chance(g, 0)) / 2) / (sums + mass)

    return {g: math.log(chance(g, 1)) - math.log(chance(g, 2)) for g in counts}


ROWS = [("Aba aba! Bab", 1), ("x abab", 0), ("", 0), ("ébé aba", None), ("baba xx aba", 1), ("baba xx, xab", 0), ("1 2 !", 1)]


def test_counts_and_gains_agree_with_plain_ones(spark):
    table = spark.createDataFrame(ROWS, "text string, class int").repartition(3)
    exact = toxicity.class_grams(table)
    number = lambda g: int.from_bytes(g, "big")
    plain = plain_counts(ROWS)
    assert {r.k: [r["all"], r.toxic, r.ordinary] for r in exact.collect()} == {number(g): c for g, c in plain.items()}
    got = {r.k: r.gain for r in toxicity.gains(exact).collect()}
    want = {number(g): x for g, x in plain_gains(plain).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    assert len({round(x, 6) for x in got.values()}) > 5


def test_features_agree_with_plain_ones_sent_or_joined(spark):
    plain = plain_gains(plain_counts(ROWS))
    table = spark.createDataFrame([(int.from_bytes(g, "big"), float(x)) for g, x in plain.items()], "k long, gain float")
    texts = ["Aba xab bab", "", None, "baba! " * 4000, "unseen words", "aba\n\naba é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)

    def features(text):
        own = [sum(plain.get(g, 0.0) for g in gs) for _, gs in plain_grams(text or "")]
        n = max(len(own), 1)
        return [sum(own) / n, sum(x > toxicity.STRONG for x in own) / n, sum(max(x - toxicity.STRONG, 0) for x in own) / n]

    for most in (10**6, 0):
        got = {r.doc_id: r.x for r in toxicity.with_features(docs, table, "x", most).collect()}
        assert all(np.allclose(got[i], features(t), atol=1e-5) for i, t in enumerate(texts)) and len(got) == len(texts)


def test_joined_scores_equal_sent_ones(spark, corpus):
    docs, labels = corpus
    table, known = spark.createDataFrame([*docs[:300], docs[0]], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sent, joined = (sorted((r.doc_id, round(r.score, 8)) for r in toxicity.scored(table, known, most=most).collect()) for most in (10**6, 0))
    assert sent == joined and len(sent) == 301


def test_slices_keep_every_word_of_very_long_texts():
    texts = ["ab cd" * 50, "", "z" * 500, "e f g"]
    for piece in (1, 7, 100, 10**6):
        words = [(int(d), part[a:b].tobytes()) for part, start, end, doc in toxicity.slices(texts, piece) for a, b, d in zip(start, end, doc, strict=True)]
        assert words == [(i, w.encode()) for i, t in enumerate(texts) for w in t.split()]


def test_a_class_that_the_curve_misses(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame(docs[:400], "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = spark.createDataFrame([(i, t) for i, t in labels if fold(i) != 4], "doc_id long, toxic int")
    got = toxicity.rated(spark, table, known).toPandas()
    truth = got["doc_id"] % 5 == 0
    assert got["score"][truth].median() > 0.5 > got["score"][~truth].median()


def test_every_learnable_label_is_counted(spark, corpus, monkeypatch):
    docs, labels = corpus
    seen = []
    count = toxicity.class_grams
    monkeypatch.setattr(toxicity, "class_grams", lambda rows: seen.append((rows.count(), rows.filter("class is not null").count())) or count(rows))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (toxicity.LABEL_ROWS, 0):
        monkeypatch.setattr(toxicity, "LABEL_ROWS", most)
        toxicity.learnt(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert seen == [(len(docs), sum(zlib.crc32(str(i).encode()) % 5 in (1, 2, 3) for i, _ in labels))] * 2
