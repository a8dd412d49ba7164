"""Byte-level deduplication: remove what a string of ``MIN_LEN`` bytes covers that starts elsewhere too.

Every window of MIN_LEN bytes has an anchor, the least of its leading 16-byte hashes. The bytes from
the anchor on that each window with it holds, MIN_LEN less the reach of anchors, are its run: equal
windows have equal runs, so runs at one place only can't hold repeats and go. Windows that follow one
another with one anchor form a stretch. Stretches that are equal as a whole settle all their windows.
What is left are the ends of repeats, one copy of each distinct stretch; a task that holds a run cuts
them into parts of ``PART`` windows and drops or settles these alike, by longer runs.

On the rest the suffix array's common prefixes are found by breadth-first backward extension on the
Burrows-Wheeler transform: intervals of strings of 0, 1, 2, ... bytes are extended to the left, and
the first interval that ends at a boundary gives the common prefix there. Values come in increasing
order, and the search stops at MIN_LEN: boundaries it hasn't met are repeats. A run with more than
``LIMIT`` distinct stretches, too many for a task, has their windows compared singly, by hash.

Stretches are equal where 64 bits of the run and 64 of the whole are; a run's key alone drops nothing
that repeats. No group's rows meet in one task: a run's places are counted by aggregates that combine
before they are shuffled, and joins carry the result back.

Defined results: null counts as the empty text; texts below MIN_LEN bytes keep all; texts that equal
another row's lose all from MIN_LEN bytes on. Rows that repeat are documents of their own. A very long
text is taken apart by one task, which holds some 60 bytes for each of its bytes. Columns that
documents have besides don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import run_ends, whole_groups
from .shared import drop_table, text_key, text_or_empty, written
from .shingles import mixed64, pieces, prefix_hash, span_hash

MIN_LEN = 400
GRAM = 16
SPAN = 192
#: Window starts that a part of a stretch holds.
PART = 16
#: Distinct stretches of a run that one task indexes; beyond, windows are compared by hash.
LIMIT = 4096
#: Bytes that are indexed at once.
BATCH = 1_000_000


def _spans(min_len: int) -> tuple[int, int]:
    """Hash length and reach of anchors for a minimum length."""
    gram = min(GRAM, max(1, min_len // 8))
    return gram, max(1, min(SPAN, (min_len - gram) // 2))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(texts: list[bytes], min_len: int = MIN_LEN) -> tuple[np.ndarray, ...]:
    """Of texts of at least min_len bytes: text index, first and last window start, bytes from the first to the anchor, run and stretch hash."""
    gram, span = _spans(min_len)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = mixed64(span_hash(prefix, at, at + gram))
    least = window_least((hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), span)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # window starts whose leading hashes lie in one text
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    valid = start + span + gram - 1 <= ends[text]
    start, text, anchor = start[valid], text[valid], anchor[valid]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    own, low, text = anchor[first], start[first], text[first]
    high = np.append(start[first[1:] - 1], start[-1])
    high = np.minimum(high, ends[text] - min_len)
    some = low <= high
    own, low, high, text = own[some], low[some], high[some], text[some]
    begin = np.append(0, ends)[text]
    runs = mixed64(span_hash(prefix, own, own + min_len - span + 1))
    whole = mixed64(span_hash(prefix, low, high + min_len) + mixed64(((own - low) << 20 | (high - low)).astype(np.uint64)))
    return text, low - begin, high - begin, own - low, runs.view(np.int64), whole.view(np.int64)


def parts(strings: list[bytes], ahead: np.ndarray, min_len: int, part: int = PART) -> tuple[np.ndarray, ...]:
    """Stretches cut where the distance of a window to its anchor, ``ahead`` at the first, is a multiple of
    ``part``: string index, first and last window, hash of the bytes that all windows so placed hold, hash of the whole.
    """
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size) - size
    prefix = prefix_hash(np.frombuffer(b"".join(strings), np.uint8))
    near, far = (ahead - (size - min_len)) // part, ahead // part
    n = far - near + 1
    row = np.repeat(np.arange(len(strings)), n)
    place = np.repeat(near, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    low = np.maximum(ahead[row] - place * part - part + 1, 0)
    high = np.minimum(ahead[row] - place * part, size[row] - min_len)
    core = begin[row] + ahead[row] - place * part
    key = mixed64(span_hash(prefix, core, core + min_len - part + 1) + mixed64(place.astype(np.uint64)))
    whole = mixed64(span_hash(prefix, begin[row] + low, begin[row] + high + min_len) + mixed64(((ahead[row] - low) << 20 | (high - low)).astype(np.uint64)))
    return row, low, high, key, whole


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of the symbols in order of their first ``depth`` ones, and each one's place.

    A rotation's rank is the first place of those that tie with it. Each round sorts the tied ones
    by the ranks that follow theirs, twice (or, in short inputs, three times) as deep as before.
    """
    n = len(symbols)
    wide = symbols.astype(np.int64)
    key, span = np.zeros(n, np.int64), min(7, n)
    for i in range(span):
        key = key << 9 | np.roll(wide, -i)
    order = np.argsort(key)
    heads = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    times, bits = (3, 21) if n < 1 << 21 else (2, 31)
    while span < depth:
        slots = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        if not len(slots):
            break
        tied = order[slots]
        key = rank[tied]
        for k in range(1, times):
            key = key << bits | rank[(tied + k * span) % n]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        order[slots] = tied
        heads[slots] = own = np.append(True, key[1:] != key[:-1])
        rank[tied] = slots[own][np.cumsum(own) - 1]
        span *= times
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def repeats(symbols: np.ndarray, min_len: int) -> np.ndarray:
    """Whether the string of min_len symbols at each position, read around the end, starts elsewhere.

    Breadth-first backward extension of intervals; a boundary between neighbours in suffix order
    that no string shorter than min_len has set apart joins two equal strings.
    """
    n = len(symbols)
    order, place = suffix_order(symbols, min_len)
    before = order - 1
    before[before < 0] += n
    left, step = symbols[before].astype(np.int64), place[before]
    apart = np.zeros(n + 1, bool)
    apart[0] = apart[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(min_len):
        if not len(low):
            break
        width = high - low
        one = width == 1
        new_low, new_high = step[low[one]], step[low[one]] + 1
        low, width = low[~one], width[~one]
        if len(low):
            group = np.repeat(np.arange(len(low)), width)
            rows = np.arange(len(group)) + np.repeat(low - (np.cumsum(width) - width), width)
            key = group << 9 | left[rows]
            by = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.append(True, key[by[1:]] != key[by[:-1]]))
            least = np.minimum.reduceat(step[rows][by], cut)
            new_low = np.concatenate([new_low, least])
            new_high = np.concatenate([new_high, least + np.diff(np.append(cut, len(by)))])
        fresh = ~apart[new_high]
        low, high = new_low[fresh], new_high[fresh]
        apart[high] = True
    joined = ~apart
    again = joined[:-1] | joined[1:]
    return again[place]


def repeated_ranges(strings: list[bytes], min_len: int) -> list[list[tuple[int, int]]]:
    """Of each string the byte ranges that repeated windows cover, windows being those of all strings."""
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(strings), np.int16)
    for b, s in zip(begin.tolist(), strings, strict=True):
        symbols[b : b + len(s)] = np.frombuffer(s, np.uint8)
        symbols[b : b + len(s)] += 1
    again = repeats(symbols, min_len)
    out = []
    for b, size in zip(begin.tolist(), sizes.tolist(), strict=True):
        at = np.flatnonzero(again[b : b + max(size - min_len + 1, 0)])
        cut = np.flatnonzero(np.diff(at) > 1)
        out.append([] if not len(at) else list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + min_len).tolist(), strict=True)))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal ranges of the bytes that the ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def ends_of_repeats(strings: list[bytes], ahead: np.ndarray, runs: np.ndarray, twice: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Of distinct stretches in whole runs: index and byte range of what repeats in those that aren't known to occur twice."""
    row, low, high, key, whole = parts(strings, ahead, min_len, min(PART, max(1, min_len // 4)))
    _, run = np.unique(runs, return_inverse=True)
    key = mixed64(key + mixed64(run[row].astype(np.uint64)))
    order = np.lexsort((whole, key))
    row, low, high, key, whole = row[order], low[order], high[order], key[order], whole[order]
    heads = np.append(True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])) if len(key) else np.zeros(0, bool)
    group = np.cumsum(heads) - 1  # of equal parts
    again = (np.bincount(group) > 1) | (np.bincount(group, twice[row]) > 0)
    of_key = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.zeros(0, np.int64)
    first = np.flatnonzero(heads)
    # keys with several parts of which one isn't settled yet
    several = np.bincount(of_key[first]) > 1
    several &= np.bincount(of_key[first], ~again) > 0
    new = ~twice[row]
    settled = new & again[group]
    out = [(row[settled], low[settled], high[settled] + min_len)]
    left = first[several[of_key[first]]]
    if len(left):
        found = repeated_ranges([strings[r][a : b + min_len] for r, a, b in zip(row[left].tolist(), low[left].tolist(), high[left].tolist(), strict=True)], min_len)
        at = np.repeat(left, [len(f) for f in found])
        flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
        own = ~again[group[at]]
        out.append((row[at][own], low[at][own] + flat[own, 0], low[at][own] + flat[own, 1]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def covered(docs: DataFrame, min_len: int = MIN_LEN, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """``text_key, low, high``: removed byte ranges of texts, not merged; and the texts that may have any."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text")).filter(F.octet_length("text") >= min_len)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = batch.column(0), [t.encode() for t in batch.column(1).to_pylist()]
            for low, high in pieces(own, BATCH):
                text, *rest = stretches(own[low:high], min_len)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(text + low)), *map(pa.array, rest)], names=["text_key", "low", "high", "ahead", "run", "whole"])

    rows = texts.select("text_key", "text").mapInArrow(parse, "text_key bigint, low bigint, high bigint, ahead bigint, run bigint, whole bigint")
    rows, all_at = written(rows, "all-stretches")
    # copies of a text are one place each; a run goes on if it has two places
    place = F.struct("text_key", "low")
    shared = rows.groupBy("run").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least < most").select("run")
    # aggregates are written before they are joined, so that Spark can split a hot run's rows in the join;
    # tables that grow with the input: no side of these joins is small in a large corpus
    shared, shared_at = written(shared, "shared-runs")
    rows, rows_at = written(rows.join(shared.hint("merge"), "run").dropDuplicates(["run", "whole", "text_key", "low"]), "stretches")
    drop_table(spark, all_at)
    drop_table(spark, shared_at)
    head = F.struct("text_key", "low", "high", "ahead")
    strings = rows.groupBy("run", "whole").agg(F.min(head).alias("head"), F.max(place).alias("last"))
    strings, strings_at = written(strings.select("run", "whole", "head", (F.struct("head.text_key", "head.low") < F.col("last")).alias("twice")), "distinct-stretches")
    # a run all of whose stretches have two places is settled, as is one with a single stretch
    open_runs = strings.groupBy("run").agg(F.count("*").alias("strings"), F.min("twice").alias("settled")).filter("not settled and strings > 1").select("run", "strings")
    open_runs, open_at = written(open_runs, "open-runs")
    heads = strings.join(open_runs.hint("merge"), "run").select("run", "whole", "strings", "twice", "head.*")
    known = texts.groupBy("text_key").agg(F.min(F.struct("doc_id")).alias("rep")).join(rows.select("text_key").distinct(), "text_key")
    known = known.select(F.col("text_key").alias("_key"), F.col("rep.doc_id").alias("_rep"))
    held = texts.join(known.hint("merge"), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text_key", "text")
    held, _ = written(held, "repeating-texts")
    fields = ("run", "strings", "twice", "low", "high", "ahead")
    wanted = heads.groupBy("text_key").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    cut = held.dropDuplicates(["text_key"]).join(wanted.hint("merge"), "text_key")
    schema = pa.schema([("run", pa.int64()), ("strings", pa.int64()), ("twice", pa.bool_()), ("text_key", pa.int64()), ("low", pa.int64()), ("ahead", pa.int64()), ("bytes", pa.binary())])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                of = {c: [p[c] for p in own] for c in fields}
                of |= {"text_key": [key] * len(own), "bytes": [raw[a : b + min_len] for a, b in zip(of["low"], of["high"], strict=True)]}
                yield pa.RecordBatch.from_pydict({c: of[c] for c in schema.names}, schema)

    cut = cut.select("text_key", "text", "parts").mapInArrow(spelled, "run bigint, strings bigint, twice boolean, text_key bigint, low bigint, ahead bigint, bytes binary")
    cut, cut_at = written(cut, "stretch-bytes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            runs, key, low, ahead = (table.column(c).to_numpy() for c in ("run", "text_key", "low", "ahead"))
            twice, own = table.column("twice").to_numpy(), table.column("bytes").to_pylist()
            size = np.cumsum([len(b) for b in own])
            ends, a = run_ends(runs), 0
            while a < len(own):
                # as many whole groups as a batch holds, one at least
                full = size[ends - 1] - (size[a - 1] if a else 0) <= 4 * BATCH
                b = max(int(ends[full & (ends > a)].max(initial=0)), int(ends[ends > a][0]))
                row, first, last = ends_of_repeats(own[a:b], ahead[a:b], runs[a:b], twice[a:b], min_len)
                yield pa.RecordBatch.from_arrays([pa.array(key[a + row]), pa.array(low[a + row] + first), pa.array(low[a + row] + last)], names=["text_key", "low", "high"])
                a = b

    few = cut.filter(F.col("strings") <= limit).drop("strings").repartition("run").sortWithinPartitions("run")
    out = few.mapInArrow(search, "text_key bigint, low bigint, high bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                row, first, _, key, _ = parts(part.column("bytes").to_pylist(), part.column("ahead").to_numpy(), min_len, 1)
                at = pa.array(row)
                low = pa.array(part.column("low").to_numpy()[row] + first)
                yield pa.RecordBatch.from_arrays([part.column("run").take(at), pa.array(key.view(np.int64)), part.column("text_key").take(at), low, part.column("twice").take(at)], names=["run", "window", "text_key", "low", "twice"])

    many = cut.filter(F.col("strings") > limit).mapInArrow(windows, "run bigint, window bigint, text_key bigint, low bigint, twice boolean")
    again = many.groupBy("run", "window").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.max("twice").alias("known")).filter("least < most or known").select("run", "window")
    many = many.filter("not twice").join(again.hint("merge"), ["run", "window"]).select("text_key", "low", (F.col("low") + min_len).alias("high"))
    # windows of a stretch that is found twice are all repeats, whatever else its run holds
    plain = rows.join(strings.filter("twice").select("run", "whole").hint("merge"), ["run", "whole"]).select("text_key", "low", (F.col("high") + min_len).alias("high"))
    out, _ = written(plain.unionByName(out).unionByName(many), "removed-ranges")
    for path in (rows_at, strings_at, open_at, cut_at):
        drop_table(spark, path)
    return out, held


def kept_text(text: str, ranges: list[tuple[int, int]]) -> bytes:
    """The text's bytes outside the ranges."""
    own, out, low = text.encode(), [], 0
    for a, b in merged(ranges):
        out.append(own[low:a])
        low = b
    return b"".join([*out, own[low:]])


def removed(docs: DataFrame, min_len: int = MIN_LEN, limit: int = LIMIT) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    ranges, held = covered(docs, min_len, limit)
    by_text = ranges.groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], []]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merged([(r["low"], r["high"]) for r in own])
                rows[0].append(sum(b - a for a, b in spans))
                rows[1].append(len(spans))
                rows[2].append(hashlib.sha256(kept_text(text, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["_key", "_removed", "_spans", "_sha"])

    cut = held.dropDuplicates(["text_key"]).join(by_text.hint("merge"), "text_key").select("text_key", "text", "ranges").mapInArrow(digest, "_key bigint, _removed bigint, _spans bigint, _sha string")
    own = docs.select("doc_id", text_key().alias("text_key"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), F.sha2(text_or_empty().cast("binary"), 256).alias("sha"))
    own, _ = written(own, "text-digests")
    copies = own.groupBy("text_key").agg(F.count("*").alias("copies"))
    out = own.join(copies, "text_key").join(cut, F.col("text_key") == F.col("_key"), "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= min_len)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )
