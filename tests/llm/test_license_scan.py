import math
import re
from collections import Counter

from pyspark.sql import functions as F

from arraymill.llm import license_scan as ls

MIT = """The MIT License

Copyright (c) 2001 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
ROWS = [
    (1, "a/b/c/x.txt", "code\nReleased under the MIT License.\nmore"),
    (2, "a/b/c/y.txt", "nothing here"),
    (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/z.txt", None),
    (5, "q/r.txt", "some licence of no known kind, at length and with many other words"),
    (6, "a/b/c/tiny", "Hm\nThis work is licensed under the GNU General Public License, version 3."),
    (7, None, "SPDX: released under the MIT license"),
    (8, "top", ""),
    (9, "a/b2/deep/er/w", "Copyright word"),
    (None, "q/s.txt", "x" * 5000),
    (2, "a/b/c/y.txt", "nothing here"),
    (10, "m/code.c", "int x;\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.\nint y;"),
    (11, "m/deep/other.c", "int z;"),
    (12, "n/terms.txt", MIT),
    (13, "n/main.c", "plain"),
    (14, "a/b/long", "x y " * 20000 + "\nReleased under the MIT License.\n" + "z " * 9),
]


def brute_force(rows):
    tokens = lambda s: re.findall(r"[^\W_]+(?:\.[0-9]+)*", s.lower())
    marked = lambda x: re.search(ls.MARKERS, x, re.I)
    units, heads, shares = [], [], []
    for _, p, t in rows:
        t = t or ""
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if marked(x)]
        heads.append([lines[i].strip(" ") for i in at])
        own = list(heads[-1])
        for s in range(len(lines)):
            for n in range(2, ls.NOTICE_LINES + 1):
                block = lines[s : s + n]
                if len(block) == n and any(s <= i < s + n for i in at) and all(x.strip(" ") and (len(x) <= ls.LINE_CHARS or marked(x)) for x in block):
                    own.append(" ".join(x.strip(" ") for x in block).strip(" "))
        named = re.match(ls.FILE_NAMES, (p or "").rpartition("/")[2].lower())
        whole = at and len(lines) > 1 and (named or sum(len(x) for x in re.split(r"\n\s*\n", t) if marked(x)) >= ls.FILE_SHARE * len(t))
        units.append((own, [t.strip(" ")] if whole else []))
        shares.append(sum(len(lines[i]) for i in at) / max(len(t), 1))
    total = sum(map(len, heads))
    df = Counter(w for own in heads for h in own for w in set(tokens(h)))
    idf = lambda w: math.log((1 + total) / (1 + df[w])) + 1
    vec = lambda s: {w: n * idf(w) for w, n in Counter(tokens(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cos = lambda a, b: round(sum(a[w] * b.get(w, 0) for w in a) / (norm(a) * norm(b)), 6)
    best_of = lambda own: min(((-cos(vec(h), vec(n)), name) for h in own for name, n in ls.TEMPLATES if tokens(h)), default=None)
    own, is_file = [], []
    for (_, p, _), (parts, whole), share in zip(rows, units, shares, strict=True):
        best = best_of(parts + whole)
        own.append(best if best and -best[0] >= ls.THRESHOLD else None)
        as_whole = best_of(whole)
        named = re.match(ls.FILE_NAMES, (p or "").rpartition("/")[2].lower())
        is_file.append(bool(own[-1] and (named or share >= ls.FILE_SHARE or (as_whole and -as_whole[0] >= ls.THRESHOLD))))
    stated = [any(re.search(ls.STATED, h, re.I) for h in hs) for hs in heads]
    files = {}
    for (_, p, _), o, f in zip(rows, own, is_file, strict=True):
        folder = (p or "").rpartition("/")[0]
        if f:
            files[folder] = min(files.get(folder, (0, "", "")), (*o, p or ""))
    out = []
    for (d, p, _), o, said in zip(rows, own, stated, strict=True):
        folder = (p or "").rpartition("/")[0]
        parts = folder.split("/") if folder else []
        near = next(("/".join(parts[:k]) for k in range(len(parts), -1, -1) if "/".join(parts[:k]) in files), None)
        near = None if o or said else near
        out.append((d, p or "", o and o[1], o and -o[0], o[1] if o else near is not None and files[near][1] or None, near))
    return out


def test_agrees_with_brute_force(spark):
    table = spark.createDataFrame([(*r, "key") for r in ROWS], "doc_id long, path string, text string, header string").repartition(3)
    got = ls.scan(table, F.col("path"))
    key = lambda r: tuple(map(str, r))
    found = sorted([tuple(r) for r in got.collect()], key=key)
    assert found == sorted(brute_force(ROWS), key=key)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    licence = {r[0]: (r[2], r[4], r[5]) for r in found}
    assert licence[10] == ("MPL-2.0", "MPL-2.0", None) and licence[12][0] == "MIT" and licence[13] == (None, "MIT", "n") and licence[14][0] == "MIT"
    assert any(r[5] == "a" for r in found) and any(r[5] == "a/b/c" for r in found)


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, path string, text string"), F.col("path")).count() == 0


def test_own_statements_hold_before_inheritance(spark):
    rows = [(1, "d/LICENSE", "Released under the MIT License."), (2, "d/a.txt", "Text that is much longer than its notice\nLicensed under CC BY-NC 4.0."), (3, "d/b.txt", "Licensed under the terms of nobody knows what, but its own\n" + "more text " * 9), (4, "d/c.txt", "nothing"), (5, "d/e.txt", "Copyright somebody")]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert (got[2].own_license, got[2].own_score, got[2].license) == ("CC-BY-NC-4.0", 1.0, "CC-BY-NC-4.0")
    assert (got[3].own_license, got[3].license, got[3].inherited_from) == (None, None, None)
    assert all((got[i].license, got[i].inherited_from) == ("MIT", "d") for i in (4, 5))


def test_notices_that_differ_in_few_words_are_told_apart(spark):
    """Each template of several lines, wrapped and with its blanks as publishers have them, as a file of its own."""
    notices = [(name, " ".join(text.split())) for name, text in ls.TEMPLATES if "\n" in text]
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"} <= {n for n, _ in notices}
    rows = [(i, f"p{i}/x.txt", re.sub(r"(.{60,75}) ", r"\1\n", text)) for i, (_, text) in enumerate(notices)]
    got = {r.doc_id: r.own_license for r in ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got == {i: name for i, (name, _) in enumerate(notices)}
