"""N-gram Jaccard join with Bayesian pruning of MinHash candidates and exact verification.

1. Documents with the same set of shingles form one node, so copies never meet as pairs.
2. Nodes that agree in a band of MinHash values are candidates. Bands whose members are the same set
   are compared once. Within a band, pairs are compared a few MinHash values at a time; a pair whose
   posterior probability of reaching the threshold falls below the tolerance is dropped.
3. The survivors' components bring the texts together; there the shingle sets are compared exactly,
   whole blocks at once, and only counts and a spanning forest leave a task.

A band or component beyond the block size is dealt out as pairs of blocks, each a task's work.

Defined results: null counts as the empty text; a text without words links with nothing and is a
class of its own; texts shorter than a shingle are alike only if their words are the same. Rows with
the same id and text are documents of their own, copies of one another. class_id is the smallest
doc_id of the class (null if it has no other). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, dealt_blocks, joined_labels, run_ends, whole_groups
from .shared import drop_table, give_back, text_key, text_or_empty, written
from .shingles import mixed64, pieces, shingle_hashes

WIDTH = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
STEP = 16
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-5
BLOCK = 1024

_rng = np.random.default_rng(20_240_607)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For n = step, 2 step, ...: the fewest of n equal values with which a pair stays.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), and the
    chance that it reaches t is that of at most m successes in n + 1 draws of probability t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        reach = np.cumsum([math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)])
        out.append(int(np.searchsorted(reach, tolerance)))
    return out


def signatures(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a digest of its shingle set, its number of distinct shingles, 16 bits of each MinHash."""
    node = np.zeros(len(texts), np.int64)
    size = np.zeros(len(texts), np.int64)
    sig = np.zeros((len(texts), HASHES), np.uint16)
    for low, high in pieces(texts):
        hashes, offset = shingle_hashes(texts[low:high], width)
        some = np.flatnonzero(np.diff(offset))
        if not len(some):
            continue
        for i in some:
            own = np.unique(hashes[offset[i] : offset[i + 1]])
            size[low + i] = len(own)
            node[low + i] = np.uint64(np.add.reduce(mixed64(own + np.uint64(len(own))))).astype(np.int64)
        half = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = offset[some]
        for k in range(HASHES):
            least = np.minimum.reduceat((half ^ _XOR[k]) * _ODD[k], starts)
            sig[low + some, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return node, size, sig


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_key, node, size, sig`` of every row; sig holds four 16-bit values a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                node, size, sig = signatures([t.encode() for t in part.column(2).to_pylist()], width)
                words = sig.view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array(size), lists], names=["doc_id", "text_key", "node", "size", "sig"])
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, node bigint, size bigint, sig array<bigint>")


def survivors(nodes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` that span the candidates left after Bayesian pruning."""
    least = fewest_matches(threshold, tolerance)
    members = nodes.select("node", F.posexplode("sig").alias("band", "word"))
    bucket = Window.partitionBy("band", "word")
    members = members.withColumn("n", F.count("*").over(bucket)).withColumn("set", F.bit_xor(F.xxhash64("node")).over(bucket)).filter("n > 1")
    # of buckets with the same members, the first is enough
    first = F.min(F.struct("band", "word")).over(Window.partitionBy("n", "set"))
    members = members.withColumn("first", first).filter("band = first.band and word = first.word").drop("first", "set")
    rows = dealt_blocks(members.join(nodes.select("node", "sig"), "node"), "n", block, "node", "band", "word").select("task", "node", "sig")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            task, node = table.column("task").to_numpy(), table.column("node").to_numpy()
            flat = table.column("sig").combine_chunks().flatten().to_numpy()
            sig = np.ascontiguousarray(flat).view("<u2").reshape(len(node), -1)
            last = run_ends(task)
            end = last[np.searchsorted(last, np.arange(len(task)), side="right")]
            count = end - np.arange(len(task)) - 1
            upto = np.concatenate([[0], np.cumsum(count)])
            labels, row = np.arange(len(task)), 0
            while row < len(task):
                stop = max(row + 1, int(np.searchsorted(upto, upto[row] + 300_000, side="right")) - 1)
                i = np.repeat(np.arange(row, stop), count[row:stop])
                j = i + 1 + np.arange(len(i)) - (upto[i] - upto[row])
                apart = labels[i] != labels[j]
                i, j = i[apart], j[apart]
                equal = np.zeros(len(i), np.int32)
                for k, fewest in enumerate(least):
                    cut = slice(k * STEP, (k + 1) * STEP)
                    equal = equal + (sig[i, cut] == sig[j, cut]).sum(1)
                    stay = equal >= fewest
                    i, j, equal = i[stay], j[stay], equal[stay]
                labels = joined_labels(labels, i, j)
                row = stop
            away = np.flatnonzero(labels != np.arange(len(labels)))
            if len(away):
                yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[labels[away]])], names=["u", "v"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(prune, "u bigint, v bigint").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common elements of sorted distinct arrays."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, 4_000_000 // max(m, 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((m, min(width, int(column[-1]) + 1 - low)), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def verified(docs: DataFrame, placed: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Exact links within components: rows ``kind, u, v``.

    kind 0: u and v are linked, and such rows span all linked nodes; kind 1: v of the documents that
    link with node u are in this task's blocks. placed: ``node, component, doc_id, text_key, copies``.
    """
    members = placed.groupBy("component").agg(F.count("*").alias("n")).join(placed, "component").withColumnRenamed("doc_id", "rep").withColumnRenamed("text_key", "rep_key")
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    # both sides grow with the input
    rows = rows.join(members.hint("merge"), rows["doc_id"].eqNullSafe(members["rep"]) & (rows["text_key"] == members["rep_key"]))
    rows = dealt_blocks(rows, "n", block, "node", "component").select("task", "node", "copies", "own", "low", "high", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            task, node, copies, own, low, high = (table.column(c).to_numpy() for c in ("task", "node", "copies", "own", "low", "high"))
            texts = table.column("text").to_pylist()
            ends = run_ends(task)
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
                _, at = np.unique(node[a:b], return_index=True)
                at += a
                if len(at) < 2:
                    continue
                encoded, sets = [texts[i].encode() for i in at], []
                for x, y in pieces(encoded):
                    hashes, offset = shingle_hashes(encoded[x:y], width)
                    sets += [np.unique(hashes[offset[k] : offset[k + 1]]) for k in range(y - x)]
                both = overlaps(sets)
                size = np.array([len(s) for s in sets])
                linked = both >= threshold * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(linked, False)
                if low[a] != high[a]:
                    side = own[at]
                    linked &= side[:, None] != side[None, :]
                i, j = np.nonzero(linked)
                labels = joined_labels(np.arange(len(at)), i, j)
                away = np.flatnonzero(labels != np.arange(len(at)))
                some = np.flatnonzero(linked.any(1))
                out += [(0, node[at[away]], node[at[labels[away]]]), (1, node[at[some]], linked[some] @ copies[at])]
            if out:
                kinds = np.concatenate([np.full(len(u), k, np.int32) for k, u, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([u for _, u, _ in out])), pa.array(np.concatenate([v for _, _, v in out]).astype(np.int64))], names=["kind", "u", "v"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "kind int, u bigint, v bigint")


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row a document: ``doc_id, text_key, node, class_id, n_links, class_size, kept``.

    n_links counts the other documents at or above the threshold; class_id names the documents that
    links connect; kept marks the row that stands for the class (of rows that repeat, all).
    """
    spark = docs.sparkSession
    rows, rows_at = written(sketched(docs, width), "ngram-rows")
    worded = rows.filter("size > 0")
    nodes = worded.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    nodes, nodes_at = written(nodes, "ngram-nodes")
    candidate = components(survivors(nodes, threshold, tolerance, block))
    placed = candidate.join(nodes.select("node", "copies", "rep.*"), "node")
    placed, placed_at = written(placed, "ngram-placed")
    links, _ = written(verified(docs, placed, threshold, width, block), "ngram-links")
    linked = components(links.filter("kind = 0"))
    counts = links.filter("kind = 1").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("others"))
    known = nodes.select("node", "least", "rep", "copies").join(linked, "node", "left").join(counts, "node", "left")
    known = known.withColumn("root", F.coalesce("component", "node"))
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"), F.min("rep").alias("head"), F.sum("copies").alias("class_size"))
    known = known.join(classes, "root").select("node", "class_id", "class_size", F.struct(F.col("head.doc_id"), F.col("head.text_key")).alias("head"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known, _ = written(known, "ngram-known")
    for path in (nodes_at, placed_at):
        drop_table(spark, path)
    rows = rows.drop("sig")
    empty = rows.filter("size = 0").select("doc_id", "text_key", "node", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    kept = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_key") == F.col("text_key"))
    return rows.filter("size > 0").join(known, "node").select("doc_id", "text_key", "node", "class_id", "n_links", "class_size", kept.alias("kept")).unionByName(empty)


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with one left of each class, the one with the least id."""
    found = join(docs, **options)
    kept = found.filter("kept").groupBy("doc_id", "text_key", (F.col("class_size") > 1).alias("several")).agg(F.count("*").alias("rows"))
    kept = kept.toDF("_join_d", "_join_k", "_join_several", "_join_rows")
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_join_d"]) & (text_key(docs["text"]) == kept["_join_k"]))
    repeats = F.col("_join_several") & (F.col("_join_rows") > 1)
    once = joined.filter(~repeats).select(*docs.columns)
    return once.unionByName(joined.filter(repeats).dropDuplicates(["_join_d", "_join_k"]).select(*docs.columns))
