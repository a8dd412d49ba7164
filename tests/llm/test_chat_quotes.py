import re

from arraymill.llm import chat_quotes as cq

ROWS = [
    ("c1", 0, "user", "Hello there.\nSecond  line\n\nNew paragraph\nwith two lines"),
    ("c1", 1, "assistant", "Own words"),
    ("c1", 2, "user", "> hello There.\n> second line\nI mean that"),
    ("c1", 3, "assistant", "> Own words\n> > second line\nyes\n>\n> nobody said so"),
    ("c1", 4, "user", ">new paragraph\n> with two   lines\n>> own words\nok"),
    ("c1", 5, "user", "no quote"),
    ("c1", 6, "user", None),
    ("c1", 8, "user", "> I mean that\n"),
    ("c1", 9, "user", ">>> own words\n\nEnd"),
    ("c2", 0, "user", "> own words\nother conversation"),
    ("c2", 0, "user", "> own words\nother conversation"),
    (None, 3, "user", "> lost"),
    ("c3", None, "user", "no turn"),
    ("c4", 7, "user", "alone " * 4000),
    ("c5", 0, "user", "One is first. Two comes\nnext. Three is here.\nFour\n\nFive is far away.\n\nSix ends it."),
    ("c5", 1, "assistant", "Unrelated words here. Four\nTwo comes next."),
    ("c5", 2, "user", "> One is first. Two comes\n> next. Three is here.\nadjacent lines"),
    ("c5", 3, "user", "> Two comes next. Three is here.\nwrapped otherwise"),
    ("c5", 4, "user", "> Five is far away.\n>\n> Six ends it.\ntwo of three paragraphs"),
    ("c5", 5, "user", "> unrelated words here.\na sentence of a line"),
    ("c5", 6, "user", "> Three is here.\n> and a long line that nobody has ever said before\nless than half"),
    ("c5", 7, "user", "\n".join(["> One is first.", *[f"> {'x' * k}" for k in range(1, 4)], "> Six ends it.", "many lines"])),
    ("c5", 8, "user", "\n".join(f"{'>' * (k % 3)} line {k}" for k in range(3000))),
]


def level(line):
    return re.match(r"^\s*((?:>\s?)*)", line).group(1).count(">")


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip(" ")


def pieces(lines):
    """Normalised lines, sentences, paragraphs of a passage."""
    paragraphs = re.split(r"\n\s*\n", "\n".join(lines))
    return {norm(x) for x in lines} - {""}, {x for p in paragraphs for x in re.split(r"(?<=[.!?]) ", norm(p))} - {""}, {norm(p) for p in paragraphs}


def brute_force(rows):
    said, quotes = {}, {}
    for c, t, _, text in rows:
        if c is None or t is None:
            continue
        runs = []
        for line in (text or "").split("\n"):
            n = level(line)
            body = re.sub(r"^\s*((?:>\s?)*)", "", line) if n else line
            if runs and runs[-1][0] == n:
                runs[-1][1].append(body)
            else:
                runs.append((n, [body]))
        for at, (n, lines) in enumerate(runs):
            whole = norm("\n".join(lines))
            if n == 0:
                said.setdefault((c, t), set()).update(set().union(*pieces(lines), {whole}) - {""})
            elif whole:
                quotes.setdefault((c, t), []).append((n, at, whole, lines))
    nodes = sorted({(c, t) for c, t, _, _ in rows if c is not None and t is not None})

    def last(c, t, unit):
        return max((u for d, u in nodes if d == c and u < t and unit in said.get((c, u), ())), default=None)

    def covering(c, t, lines):
        kinds = pieces(lines)[:2]
        best = []
        for m in {last(c, t, u) for k in kinds for u in k} - {None}:
            share = max(round(sum(len(u) for u in k if u in said[c, m]) / sum(map(len, k)), 9) for k in kinds if k)
            best.append((share, m))
        return max((b for b in best if b[0] >= cq.COVER), default=(0, None))[1]

    reply, counts = {}, {}
    for c, t in nodes:
        links = []
        for n, at, q, lines in quotes.get((c, t), []):
            whole = last(c, t, q)
            links.append((n, -at, covering(c, t, lines) if whole is None else whole))
        got = min(((n, at, -o) for n, at, o in links if o is not None), default=None)
        reply[c, t] = -got[2] if got else t - 1 if (c, t - 1) in nodes else None
        counts[c, t] = len(links), sum(o is not None for *_, o in links)
    thread = {}
    for c, t in nodes:
        r = reply[c, t]
        first = r is not None and t == min(u for d, u in nodes if d == c and reply[d, u] == r)
        thread[c, t] = thread[c, r] if first else t
    place = {k: sorted((thread[n], n[1]) for n in nodes if n[0] == k[0]).index((thread[k], k[1])) for k in nodes}
    out = []
    for c, t, role, text in rows:
        k = (c, t)
        own = "\n".join(x for x in (text or "").split("\n") if not re.match(r"^\s*>", x)).strip(" ")
        out.append((c, thread.get(k), t, role, reply.get(k), *counts.get(k, (0, 0)), re.sub(r"^\n+|\n+$", "", own), place.get(k)))
    return out


def test_agrees_with_brute_force(spark):
    table = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id string, turn long, role string, text string, level int").repartition(3)
    got = [tuple(r) for r in cq.conversations(table).collect()]
    key = lambda r: tuple(map(str, r))
    once = [r for i, r in enumerate(ROWS) if r not in ROWS[:i]]
    assert len(got) == len(ROWS)
    assert sorted(set(got), key=key) == sorted(set(brute_force(once)), key=key)
    reply = {r[2]: r[4] for r in got if r[0] == "c5"}
    assert [reply[t] for t in range(8)] == [None, 0, 0, 0, 0, 1, 5, 0]


def test_empty_table(spark):
    assert cq.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
