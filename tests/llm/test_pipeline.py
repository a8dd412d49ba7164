"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_line_dedup import brute_force as plain_lines
from test_ngram_join import plain_shingles
from tokenizers import Tokenizer

import corpus_pipeline
from arraymill.llm import line_dedup, mixing, toxicity
from arraymill.llm.queries import vocabulary


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9)))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words, n))
    passage, rows, labels = line(40), [], []
    for i in range(400):
        own = [line(int(rng.integers(3, 30))) for _ in range(int(rng.integers(1, 4)))]
        if i % 4 == 0:
            own[0] += " grobnak vilthor" * max(1, len(own[0].split()) // 10)
        if i % 9 == 1:
            own.insert(1, passage)
        rows.append((i, "\n".join(own), "en", f"s{i % 4}" if i % 7 else None, 0))
        if i % 3:
            labels.append((i, 1, int(i % 4 == 0)))
    for k in (1, 2, 3):
        text = rows[k][1].split(" ")
        text[-1] = "changed"
        rows.append((500 + k, " ".join(text).replace("\n", "\n\n", 1), "en", "s1", 0))
    rows += [(602, rows[11][1], "en", "s3", 0), (600, None, "en", "s2", 0), (601, "", "en", "s2", 0), (rows[5][0], *rows[5][1:])]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    scores = {(r.doc_id, r.score >= 0.5) for r in toxicity.rated(spark, docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    toxic = {d for d, bad in scores if bad}
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] < 400}
    assert sum((d in toxic) == (d % 4 == 0) for d in held) >= 0.9 * len(held)
    civil = [r for r in rows if r[0] not in toxic]
    cleaned = plain_lines([(r[0], r[1]) for r in civil], line_dedup.MIN_CHARS)
    lined = [(r[0], cleaned[True, r[0], r[1] or ""][0], r[3]) for r in civil]
    # copies that lose all lines go
    lined = [own for own, r in zip(lined, civil, strict=True) if own[1] or not r[1]]
    assert len(lined) < len(civil)
    sets = [plain_shingles(t) for _, t, _ in lined]
    group = list(range(len(lined)))
    for i in range(len(lined)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for (d, t, s), g in zip(lined, group, strict=True):
        best[g] = min(best.get(g, (d, t, s)), (d, t, s), key=lambda x: x[0])
    kept = {d: (t, s) for d, t, s in best.values()}
    pieces = corpus_pipeline.run(spark, path).collect()
    # documents that the mix takes several times are packed as often
    plain = Tokenizer.from_file(vocabulary())
    times = Counter(r.doc_id for r in pieces if r.start == 0)
    assert set(times) <= set(kept)
    for r in pieces:
        ids = [*plain.encode(kept[r.doc_id][0] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sizes = {d: len((t or "").encode().split()) for d, (t, _) in kept.items()}
    by_source = Counter()
    for d, (_, s) in kept.items():
        by_source[s] += sizes[d]
    ordered = sorted(s for s in by_source if s is not None) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(ordered)}
    aim, fixed, total = {}, {}, sum(by_source.values())
    while True:
        free = [s for s in ordered if s not in fixed]
        aim = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if aim[s] > 3 * by_source[s]]
        if not above:
            break
        fixed |= {s: 3.0 * by_source[s] for s in above}
    for s, target in (fixed | aim).items():
        taken = sum(sizes[d] * times[d] for d in kept if kept[d][1] == s)
        assert abs(taken - target) <= max(sizes[d] for d in kept if kept[d][1] == s)
    assert max(times.values()) <= 3


def test_stages_keep_columns_and_empty_tables(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == 0
