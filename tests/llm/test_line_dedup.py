import numpy as np
import pytest

from arraymill.llm import line_dedup


def brute_force(rows, min_chars):
    """Indexes of lines in runs of min_chars characters that an earlier place has as well."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    lines = [t.split("\n") for _, _, t in docs]
    places = [(x, i) for x, own in enumerate(lines) for i in range(len(own))]
    gone = {x: set() for x in range(len(docs))}
    for p, (x, i) in enumerate(places):
        for y, j in places[:p]:
            k = chars = 0
            while i + k < len(lines[x]) and j + k < len(lines[y]) and lines[x][i + k] == lines[y][j + k]:
                chars += len(lines[x][i + k]) + 1
                k += 1
            if chars >= min_chars:
                gone[x] |= set(range(i, i + k))
    return {docs[x]: ("\n".join(s for i, s in enumerate(lines[x]) if i not in gone[x]), len(gone[x])) for x in gone}


@pytest.mark.parametrize("min_chars", [1, 9, 30])
def test_agrees_with_brute_force(spark, min_chars):
    rng = np.random.default_rng(4)
    pool = ["", "a", "bb", "c c c", "line number five", "x" * 12, "é"]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 14))))) for i in range(18)]
    rows += [(None, rows[3][1]), (50, None), (51, ""), (52, "\n\n"), (53, rows[0][1]), (53, rows[0][1])]
    rows = [(d, t) for d, t in rows]
    table = spark.createDataFrame([(*r, 9, "q") for r in rows], "doc_id long, text string, n_chars int, gone string").repartition(3)
    expected = brute_force(rows, min_chars)
    got = line_dedup.deduplicated(table, min_chars)
    assert got.columns == [*table.columns, "n_lines", "n_removed"]
    found = [(r.doc_id, r.n_lines, r.text, r.n_removed, r.n_chars) for r in got.collect()]
    assert len(found) == len(rows)
    want = []
    for d, t in rows:
        text, n = expected[(d is not None, d or 0, t or "")]
        want.append((d, len((t or "").split("\n")), text if n or t is not None else None, n, len(text) if n else 9))
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(want, key=key)
    assert line_dedup.without_repeats(table, min_chars).columns == table.columns


def test_ranks_are_places_in_suffix_order(spark):
    texts = ["x\ny\nz\nw", "y\nz\nw", "q\nx\ny", "z\nw"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids = line_dedup.line_ids(table, 1)
    lines = ids.selectExpr("doc_id", "text_key", "posexplode(arrays_zip(a, b)) AS (pos, id)").selectExpr("doc_id", "text_key", "pos", "id.a", "id.b").collect()
    name = {(r.doc_id, r.pos): (r.a, r.b) for r in lines}
    once = line_dedup.numbered(spark.createDataFrame(lines), "a", "b")[0].collect()
    repeated = sorted({n for n in name.values() if list(name.values()).count(n) > 1})
    assert {(r.doc_id, r.pos): r.rank for r in once} == {p: repeated.index(n) for p, n in name.items() if n in repeated}


def test_columns_named_like_counts_keep_their_values(spark):
    line = "a line that is certainly longer than fifty characters in all"
    rows = [(1, f"{line}\nown", "mine", 1.5), (2, line, "yours", 2.5), (3, "", "theirs", 3.5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, n_lines double")
    assert [tuple(r) for r in line_dedup.without_repeats(table).orderBy("doc_id").collect()] == [rows[0], (2, "", "yours", 2.5), rows[2]]
    assert [r.doc_id for r in line_dedup.without_repeats(table, keep_emptied=False).orderBy("doc_id").collect()] == [1, 3]


def test_very_long_text(spark):
    lines = [f"line {i} of a long text that goes on for more than fifty characters" for i in range(30_000)]
    table = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[100:29_000]) + "\nown line")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.deduplicated(table).collect()}
    assert got[1][0] == 0 and got[2] == (28_900, "own line")


def test_no_python_in_the_plan_and_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    out = line_dedup.deduplicated(table)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
