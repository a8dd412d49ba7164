"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

A text's 64-bit key addresses a directory by its leading bits. The directory doubles as long as a bucket
holds more bytes than it may, which splits the overfull buckets by one more bit; a bucket is a range of
keys. Each document goes to the owner of its bucket once. The owner's task compares bytes: rows of a key
fall together only where their texts are equal throughout, so different texts of one key become links of a
chain. The entries, without the texts but for those of a longer chain, are the index's files; documents
then find their entry by key, and in a longer chain by their bytes.

Keys that many rows have skip the owners: Spark combines their equal rows in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, same_id, text_or_empty, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a bucket holds before it splits; more where the directory would pass its depth.
BUCKET_BYTES = 8 << 20
#: Bits of the deepest directory. What is sent to the executors has a row for each of its slots at most.
DEPTH = 18
#: A key with more than this share of the rows is combined before the shuffle; fewer than 100,000 keys can be.
HOT_SHARE = 100_000


def folded(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    return F.translate(text, CAPITALS, SMALL)


@dataclass(frozen=True)
class Index:
    """Tables in the shared folder.

    ``entries``: ``key, bucket, link, links, text_sha256, n_bytes, group_size, keep_id, text``, one for each
    text, with the text itself where its key has several. ``directory``: ``slot, bucket``, slots being the
    leading ``depth`` bits of keys. ``keys``: ``doc_id, key, rows, bytes``, once for each document and key.
    ``normal`` and ``hashed`` make a text's normal form and that form's key.
    """

    entries: DataFrame
    directory: DataFrame
    depth: int
    keys: DataFrame
    normal: Callable[[Column], Column]
    hashed: Callable[[Column], Column]


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _directory(cells: DataFrame, total: int, bucket_bytes: int, deepest: int) -> tuple[DataFrame, int]:
    """``slot, bucket`` and the depth that the directory has come to.

    ``cells`` are ``cell, bytes`` by the deepest slots, ``bits`` of a cell those of its bucket. Each round sums
    up the buckets and gives the cells of overfull ones a bit more. The directory starts at the depth
    that buckets of the permitted size need at least; a bucket is named by its first slot.
    """
    capacity = max(bucket_bytes, total >> (deepest - 1))
    depth = min(deepest, max(0, (total // capacity).bit_length() - 1))
    now, path = written(cells.withColumn("bits", F.lit(depth)), "exact-cells")
    prefix = lambda bits: F.call_function("shiftrightunsigned", F.col("cell"), F.lit(deepest) - bits)
    while depth < deepest:
        held = F.sum("bytes").over(Window.partitionBy("bits", prefix(F.col("bits"))))
        split, split_path = written(now.select("cell", "bytes", (F.col("bits") + ((F.col("bits") == depth) & (held > capacity)).cast("int")).alias("bits")), "exact-cells")
        drop_table(cells.sparkSession, path)
        now, path = split, split_path
        if now.filter(F.col("bits") > depth).isEmpty():
            break
        depth += 1
    short = F.lit(depth) - F.col("bits")
    bucket = F.call_function("shiftleft", prefix(F.col("bits")), short)
    return now.select(F.shiftrightunsigned("cell", deepest - depth).alias("slot"), bucket.alias("bucket")).distinct(), depth


def build(docs: DataFrame, normal: Callable[[Column], Column] = folded, hashed: Callable[[Column], Column] = F.xxhash64, bucket_bytes: int = BUCKET_BYTES, deepest: int = DEPTH, hot_share: int = HOT_SHARE) -> Index:
    """The index of all documents' texts in their normal form; null counts as empty."""
    texts = docs.select("doc_id", normal(text_or_empty(docs["text"])).alias("text")).withColumn("key", hashed(F.col("text")).cast("long"))
    sizes = texts.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).cast("long").alias("bytes"))
    keys, _ = written(sizes, "exact-keys")
    counts, counts_path = written(keys.groupBy("key").agg(F.sum("rows").alias("n"), F.max("bytes").alias("bytes")), "exact-counts")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * hot_share > rows
    weight = F.when(is_hot, F.col("bytes")).otherwise(F.col("n") * F.col("bytes"))
    cells = counts.groupBy(_leading(F.col("key"), deepest).alias("cell")).agg(F.sum(weight).alias("bytes"))
    directory, depth = _directory(cells, int(counts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]), bucket_bytes, deepest)
    directory, _ = written(directory, "exact-directory")

    # at most 2 ** deepest slots and fewer than hot_share keys
    hot = F.broadcast(counts.filter(is_hot).select("key", F.lit(True).alias("hot")))
    placed = texts.join(hot, "key", "left").withColumn("slot", _leading(F.col("key"), depth)).join(F.broadcast(directory), "slot").drop("slot")
    facts = (F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    owned = placed.filter("hot IS NULL").drop("hot").repartition("bucket").groupBy("bucket", "key", "text").agg(*facts)
    combined = placed.filter("hot").groupBy("bucket", "key", "text").agg(*facts)
    entries, _ = written(_chained(owned).unionByName(_chained(combined)), "exact-index")
    drop_table(docs.sparkSession, counts_path)
    return Index(entries, directory, depth, keys, normal, hashed)


def _chained(texts: DataFrame) -> DataFrame:
    """The different texts of each key as the links of its chain."""
    chain = Window.partitionBy("bucket", "key")
    linked = texts.withColumn("links", F.count(F.lit(1)).over(chain)).withColumn("link", F.row_number().over(chain.orderBy("text")))
    return linked.select(
        "key", "bucket", "link", "links", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"),
        "group_size", "keep_id", F.when(F.col("links") > 1, F.col("text")).alias("text"),
    )


def members(index: Index, docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each document of the index, ``docs`` being the
    documents it was made of."""
    facts = ["keep_id", "group_size", same_id(F.col("doc_id"), F.col("keep_id")).alias("kept"), "text_sha256"]
    # both sides grow with the documents; Spark deals a key that a third of them have to several tasks
    alone = index.keys.join(index.entries.filter("links = 1").hint("merge"), "key").select("doc_id", *facts)
    chains = index.entries.filter("links > 1")
    if chains.isEmpty():
        return alone
    texts = docs.select("doc_id", index.normal(text_or_empty(docs["text"])).alias("text")).withColumn("key", index.hashed(F.col("text")).cast("long"))
    compared = texts.join(chains, ["key", "text"]).select("doc_id", *facts).distinct()
    return alone.unionByName(compared)


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id`` for the rows of another table whose text the index has, compared by SHA-256."""
    texts = docs.select("doc_id", index.normal(text_or_empty(docs["text"])).alias("text"))
    asked = texts.select("doc_id", index.hashed(F.col("text")).cast("long").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return asked.join(index.entries, ["key", "text_sha256"]).select("doc_id", "keep_id")


def groups(docs: DataFrame, **options) -> DataFrame:
    """For each document the group of equal texts it is in: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays. Defined results: null text is empty text; a null
    doc_id is smaller than any other and stays only where its whole group has none; rows that repeat both
    id and text are one document, with one row, and all count in ``group_size``; rows of one id with
    different texts are documents of their own. Texts of any length are compared whole. No documents: no
    rows. Other columns don't matter, whatever their names.
    """
    return members(build(docs, **options), docs)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text any one."""
    index = build(docs, **options)
    stay = members(index, docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    own = docs.withColumn("_digest_of", F.sha2(index.normal(text_or_empty(docs["text"])).cast("binary"), 256))
    kept = own.join(stay, same_id(F.col("doc_id"), F.col("_id")) & (F.col("_digest_of") == F.col("_digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_digest_of"]).drop("_digest_of")
