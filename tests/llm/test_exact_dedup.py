import hashlib

import pytest
from pyspark.sql import functions as F

from arraymill.llm import exact_dedup

SCHEMA = "doc_id long, text string, key int, bucket string, hot string"
COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(rows):
    texts = [(d, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t, *_ in rows]
    out = set()
    for d, t in texts:
        same = [e for e, u in texts if u == t]
        keep = max((e for e in same if e is not None), default=None)
        out.add((d, keep, len(same), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    long = "A very long text. " * 60_000
    texts = ["", None, "One", "oNE", "one ", "É", "é", "two\nlines", "TWO\nLINES", "x", "İ", "\x00", "a" * 3, "hot"]
    made = [(i, texts[i % len(texts)]) for i in range(90)] + [(100 + i, "hot" if i % 2 else "HOT") for i in range(80)] + [(300 + i, f"text {i} " * (i % 7)) for i in range(120)]
    made += [(None, "hot"), (None, "only null"), (None, "only null"), (5, texts[5]), (5, texts[5]), (5, "another text of id 5"), (500, long), (501, long.upper()), (502, long + "!")]
    return [(*r, 1, "b", "h") for r in made]


OPTIONS = [
    {},  # every key of a small table is combined
    {"hot_share": 5, "bucket_bytes": 200, "deepest": 8},
    {"hot_share": 1, "bucket_bytes": 1, "deepest": 6},  # owners only, all buckets overfull
    {"hot_share": 5, "bucket_bytes": 100, "hashed": F.length},  # chains of texts of one length
    {"hot_share": 5, "bucket_bytes": 100, "hashed": lambda t: F.lit(7)},  # one chain
]


@pytest.mark.parametrize("options", OPTIONS)
def test_agrees_with_a_plain_version(spark, docs, options):
    table = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = exact_dedup.groups(table, **options)
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert rows(got) == plain(docs)


def test_directory_doubles_until_buckets_fit(spark, docs):
    index = exact_dedup.build(spark.createDataFrame(docs, SCHEMA), hot_share=1, bucket_bytes=4000, deepest=10)
    slots = {r["slot"]: r["bucket"] for r in index.directory.collect()}
    assert 2 < index.depth <= 10 and len(set(slots.values())) > 2
    # a bucket begins at its first slot and has a power of two of them
    assert all(b <= s for s, b in slots.items())
    own = {}
    for r in index.entries.collect():
        assert slots[(r["key"] & (2**64 - 1)) >> (64 - index.depth)] == r["bucket"]
        own.setdefault(r["bucket"], []).append(r["group_size"] * r["n_bytes"])
    assert all(sum(sizes) <= 4000 or len(sizes) == 1 or max(sizes) > 4000 or index.depth == 10 for sizes in own.values())


def test_lookup_and_deduplicated_documents(spark, docs):
    table = spark.createDataFrame(docs, SCHEMA)
    other = spark.createDataFrame([(1, "OnE", 0), (2, "new", 0), (3, None, 0)], "doc_id long, text string, key int")
    keep = {t: k for (_, k, _, _, t) in plain(docs)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, exact_dedup.lookup(exact_dedup.build(table), other).collect())) == [(1, keep[digest("one")]), (3, keep[digest("")])]
    kept = exact_dedup.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(r[0]) for r in plain(docs) if r[3])


@pytest.mark.parametrize("made", [[], [(1, None, 0, "", "")]])
def test_empty_tables(spark, made):
    assert rows(exact_dedup.groups(spark.createDataFrame(made, SCHEMA))) == plain(made)
