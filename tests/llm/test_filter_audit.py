import re
from collections import Counter
from itertools import permutations

import pytest

from arraymill.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, n string"


def plain(docs, labels):
    """Every document by itself, order by order."""
    docs = [(d, t or "", s or "") for d, t, s, *_ in docs]
    good, toxic = ({d for d, *v in labels if v[i] == 1} for i in (0, 1))

    def failed(d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search(r"[#$%&*|]", t)}
        out["E"] = d is not None and any(e is not None and e < d and u == t for e, u, _ in docs)
        return {k for k, v in out.items() if v}

    known = [(d, s, failed(d, t)) for d, t, s in docs]
    found, removed_by = {}, Counter()
    for part in {s for _, s, _ in known}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for d, s, f in known if s == part]
            everyone = left
            for step, x in enumerate(order, 1):
                out = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                removed_by[part, x] += len(out)
                redundant = sum(x in f for _, f in everyone) - len(out)
                found[part, order, step] = [len(left), len(out), redundant, sum(f == {x} for _, f in everyone), sum(d in good for d in out), sum(d in toxic for d in out)]
    return {(p, o, s): (*v, removed_by[p, o[s - 1]]) for (p, o, s), v in found.items()}


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_agrees_with_a_plain_audit(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = ["", None, "short", "SHOUT", "a $ sign", long, f"{long} $", "one two " * 150, "ONE TWO " * 150, f"{long} é\x85ü", "x" * 300_000, " ".join(map(str, range(200))), " ".join(map(str, range(199)))]
    docs = [(i, t, ["a", "b", None, ""][i % 4], 7, "x") for i, t in enumerate(texts * 4)]
    docs += [(None, long, "a", 0, ""), (None, "only here", "c", 0, ""), (3, texts[3], "b", 0, ""), (70, long, None, None, None)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 60, 2)] + [(4, 1, 0), (6, None, None), (None, 1, 1)]
    got = filter_audit.interactions(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")
    want = plain(docs, [x for x in labels if x[0] is not None])
    assert len(want) == 4 * 600
    assert rows(got) == want


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None)]])
def test_empty_tables_and_zeros(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(filter_audit.interactions(spark.createDataFrame(docs, SCHEMA), labels))
    assert got == plain(docs, []) and len(got) == 600 * len(docs)


def test_other_filters_and_parts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x"), (3, "a b", "y")], "doc_id long, text string, source string")
    marked = filter_audit.masks(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), F.lit("all"), {"L": F.length("text") < 2})
    got = rows(filter_audit.audit(marked, "LE"))
    assert got == {("all", "LE", 1): (2, 1, 0, 1, 0, 0, 2), ("all", "LE", 2): (1, 1, 0, 1, 1, 0, 2), ("all", "EL", 1): (2, 1, 0, 1, 1, 0, 2), ("all", "EL", 2): (1, 1, 0, 1, 0, 0, 2)}
