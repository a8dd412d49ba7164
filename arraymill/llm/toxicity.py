"""Toxicity scores from class-conditional Kneser-Ney models over the characters of words.

Two models, one learnt from toxic and one from ordinary documents, predict each byte of a word, and
the blank that ends it, from the up to five bytes before it, the blank before the word among them.
Orders 6 to 1 discount absolutely, the lower ones by Kneser-Ney continuation counts. At each order a
class rests on a shared backoff: half its own lower order, half the estimate that the counts of all
documents give at that order, which also gets ``SHARED_MASS`` pseudo-counts. What is rare in both
classes is thus likely alike in both, and only expressions that one class has again and again differ.

A word's evidence is the difference of its two log-likelihoods. A text's evidence is divided by its
number of words: the sum, the share of words beyond ``STRONG`` nats, and what these have beyond, so
that toxic expressions aren't lost in a long text. A logistic curve over these, fitted on labelled
documents that the class counts did not see, makes a score.

All learnable labelled rows and, for the shared counts, all documents are counted, exactly and by
whole keys; only the curve is fitted on a sample, of at most ``CALIBRATION`` labels. Counts and
probabilities are tables. Scores need one number an n-gram: up to ``MODEL_ROWS`` of them are sent to
the executors; a larger model stays a table, which is joined with the documents' distinct n-grams.

Defined results: null counts as the empty text, which scores by the curve at no evidence. Texts of
any length are read in slices of about ``PIECE`` bytes that end between words. Labels that are null
are left out; of several labels of a document the larger holds. Where a class has no document to fit
the curve on, ``PLAIN_CURVE`` takes its place; where one has none to count, every score is 0. A null doc_id counts as the empty string where remainders are taken. Rows that repeat are
scored alike. Columns that documents have besides don't matter, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, give_back, text_key, text_or_empty, written
from .shingles import mixed64, prefix_hash, span_hash

#: Labels that the curve is fitted on, at most.
CALIBRATION = 20_000
ORDER = 6
DISCOUNT = 0.75
#: Pseudo-counts of the shared backoff in each context of a class.
SHARED_MASS = 30.0
#: The even guess below the lowest order.
EVEN = 1 / 64
#: Nats beyond which a word's evidence stands out.
STRONG = 2.5
#: N-grams of a model that is sent to the executors, at 12 bytes each; a larger one is joined.
MODEL_ROWS = 4_000_000
#: Labels that are sent to the executors; more are joined by merge.
LABEL_ROWS = 1_000_000
#: Bytes of text that are taken apart at once.
PIECE = 1_000_000
#: Rows whose texts a task takes from a batch at once.
ROWS = 1_000
#: Means, deviations and weights for the three features where no curve can be fitted.
PLAIN_CURVE = (np.zeros(3), np.ones(3), np.array([-3.0, 0.0, 200.0, 40.0]))
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
Curve = tuple[np.ndarray, np.ndarray, np.ndarray]


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows with remainder 0 are never learnt from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def slices(texts: list[str], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some of the texts from blank to blank, where words start and end there, each word's text.

    Letters are lower-cased and ASCII characters that are no letters become blanks.
    """
    plain = [t.lower().encode().translate(_PLAIN) for t in texts]
    begin = np.cumsum([1, *(len(p) + 1 for p in plain)])
    joined = b" " + b" ".join(plain) + b" "
    data = np.frombuffer(joined, np.uint8)
    low = 0
    while low < len(data) - 1:
        high = min(low + piece, len(data) - 1)
        high = joined.find(b" ", high)
        part = data[low : high + 1]
        inside = part != 32
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = change[::2], change[1::2]
        yield part, start, end, np.searchsorted(begin, low + start, side="right") - 1
        low = high


def distinct_words(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct word, and for each word which of these it is."""
    words = mixed64(span_hash(prefix_hash(part), start, end) + (end - start).astype(np.uint64))
    _, first, which = np.unique(words, return_index=True, return_inverse=True)
    return first, which


def grams(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit keys of the six bytes that end at each byte of the words and at the blanks after them, and
    which word each is of. Bytes before the blank in front of a word are 0.
    """
    n = end - start + 1
    word = np.repeat(np.arange(len(start)), n)
    age = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = age + np.repeat(start, n)
    key = np.zeros(len(at), np.uint64)
    for i in range(ORDER):
        key |= np.where(age + 1 >= i, part[at - i], 0).astype(np.uint64) << np.uint64(8 * i)
    return key, word


def class_grams(docs: DataFrame) -> DataFrame:
    """``k, all, toxic, ordinary``: exact counts of six-byte keys, from rows of ``text, class`` (toxic 1, ordinary 0, else null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                kind = rows.column(1).fill_null(2).to_numpy(zero_copy_only=False)
                for part, start, end, doc in slices(rows.column(0).to_pylist()):
                    first, which = distinct_words(part, start, end)
                    weights = [np.bincount(which, own, minlength=len(first)) for own in (np.ones(len(doc)), kind[doc] == 1, kind[doc] == 0)]
                    key, word = grams(part, start[first], end[first])
                    keys.append(key)
                    counts.append(np.stack([w[word] for w in weights]))
                    if sum(map(len, keys)) > PIECE:
                        keys, counts = _summed(keys, counts)
            keys, counts = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts[0])], names=["k", "all", "toxic", "ordinary"])
            del keys, counts
            give_back()

    rows = docs.select("text", F.col("class").cast("int")).mapInArrow(count, "k bigint, all bigint, toxic bigint, ordinary bigint")
    return rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("all", "toxic", "ordinary")])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    if not keys:
        return [np.zeros(0, np.uint64)], [np.zeros((3, 0))]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts, axis=1)
    return [own], [np.stack([np.bincount(at, c, minlength=len(own)) for c in every])]


def gains(exact: DataFrame, discount: float = DISCOUNT, mass: float = SHARED_MASS) -> DataFrame:
    """``k, gain``: toxic minus ordinary log-probability of the last byte of each six-byte key after the others."""
    kinds = ("all", "toxic", "ordinary")
    k = F.col("k")

    def last(n: int) -> Column:
        return k.bitwiseAND(F.lit((1 << 8 * n) - 1))

    orders, paths = {ORDER: exact}, []
    for n in range(ORDER - 1, 0, -1):
        # distinct bytes before; where a word begins none can stand, and occurrences count
        whole = F.shiftright(k, 8 * n) == 0
        counted = [F.sum(F.when(whole, F.col(c)).otherwise((F.col(c) > 0).cast("long"))).alias(c) for c in kinds]
        orders[n], path = written(orders[n + 1].groupBy(last(n).alias("k")).agg(*counted), "order")
        paths.append(path)
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        # a context has at most 256 rows, one for each byte after it
        context = Window.partitionBy(F.shiftright(k, 8))
        sums = {f"{c}_n": F.sum(c).over(context) for c in kinds} | {f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(context) for c in kinds}
        rows = orders[n].withColumns(sums)
        if below is None:
            rows = rows.withColumns({f"{c}_low": F.lit(EVEN) for c in kinds})
        else:
            rows = rows.join(below.select(F.col("k").alias("short"), *[F.col(f"{c}_p").alias(f"{c}_low") for c in kinds]), last(n - 1) == F.col("short")).drop("short")
        left = {c: F.greatest(F.col(c) - discount, F.lit(0.0)) for c in kinds}
        shared = (left["all"] + discount * F.col("all_kinds") * F.col("all_low")) / F.col("all_n")
        rows = rows.withColumn("all_p", shared)
        for c in kinds[1:]:
            back = (F.col(f"{c}_low") + F.col("all_p")) / 2
            rows = rows.withColumn(f"{c}_p", (left[c] + (discount * F.col(f"{c}_kinds") + mass) * back) / (F.col(f"{c}_n") + mass))
        below = rows.select("k", *[f"{c}_p" for c in kinds])
    out, _ = written(below.select("k", (F.log("toxic_p") - F.log("ordinary_p")).cast("float").alias("gain")), "gram-gains")
    for path in paths:
        drop_table(exact.sparkSession, path)
    return out


class Gains:
    """The gain of each key; a key that isn't there gains nothing."""

    def __init__(self, keys: np.ndarray, gain: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order].astype(np.uint64), np.uint64(1 << 63))
        self.gain = np.append(gain[order], np.float32(0)).astype(np.float64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.gain[at], 0.0)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: evidence of a word, share of strong words, their excess a word."""
        n = len(texts)
        words, total, strong, excess = (np.zeros(n) for _ in range(4))
        for part, start, end, doc in slices(texts):
            first, which = distinct_words(part, start, end)
            key, word = grams(part, start[first], end[first])
            own = np.bincount(word, self(key), minlength=len(first))[which]
            words += np.bincount(doc, minlength=n)
            total += np.bincount(doc, own, minlength=n)
            strong += np.bincount(doc, own > STRONG, minlength=n)
            excess += np.bincount(doc, np.maximum(own - STRONG, 0), minlength=n)
        return np.column_stack([total, strong, excess]) / np.maximum(words, 1)[:, None]


def fitted_curve(features: np.ndarray, toxic: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> Curve:
    """Means, deviations and weights of a logistic curve, by Newton's method.

    More evidence must never lower a score: a feature that gets a weight below zero beside the
    others, as one of two that agree can, is left out.
    """
    mean, sd = features.mean(0), features.std(0) + 1e-9
    used = np.arange(features.shape[1])
    while True:
        x = np.column_stack([np.ones(len(features)), ((features - mean) / sd)[:, used]])
        w, pull = np.zeros(x.shape[1]), np.append(0.0, np.full(len(used), ridge))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (toxic - p) - pull * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        if not len(used) or w[1:].min() >= 0:
            break
        used = np.delete(used, int(np.argmin(w[1:])))
    out = np.zeros(1 + features.shape[1])
    out[0], out[1 + used] = w[0], w[1:]
    return mean, sd, out


def on_curve(features: Column, curve: Curve) -> Column:
    """The score of an array of features."""
    mean, sd, w = (x.tolist() for x in curve)
    at = F.lit(w[0])
    for i, (m, s) in enumerate(zip(mean, sd, strict=True)):
        at = at + (features[i] - m) / s * w[1 + i]
    return 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0))))


def joined_features(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``key, x``: the features of rows of ``key, text``, by joins of their distinct words' n-grams with the gains."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, end, doc in slices(batch.column(1).to_pylist()):
                first, which = distinct_words(part, start, end)
                both, n = np.unique(doc * len(first) + which, return_counts=True)
                own, raw = first[both % max(len(first), 1)], part.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both // max(len(first), 1))), pa.array([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)], pa.binary()), pa.array(n)], names=["key", "word", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            size = np.array([len(w) + 1 for w in own], np.int64)
            part = np.frombuffer(b" " + b" ".join(own) + b" ", np.uint8)
            start = np.cumsum(size) - size + 1
            key, word = grams(part, start, start + size - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word)), pa.array(key.astype(np.int64))], names=["word", "k"])

    kind = texts.schema["key"].dataType.simpleString()
    words = texts.select("key", "text").mapInArrow(apart, f"key {kind}, word binary, n bigint")
    words, _ = written(words.groupBy("key", "word").agg(F.sum("n").alias("n")), "text-words")
    spelt = words.select("word").distinct().mapInArrow(spelled, "word binary, k bigint")
    own = spelt.join(table.hint("merge"), "k", "left").groupBy("word").agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("own"))
    own = words.join(own.hint("merge"), "word")
    beyond = F.greatest(F.col("own") - STRONG, F.lit(0.0))
    sums = [F.sum(F.col("n") * x) / F.sum("n") for x in (F.col("own"), (F.col("own") > STRONG).cast("int"), beyond)]
    return own.groupBy("key").agg(F.array(*sums).alias("x"))


def with_features(docs: DataFrame, table: DataFrame, name: str, most: int = MODEL_ROWS) -> DataFrame:
    """The documents and, in a further column, their features."""
    spark = docs.sparkSession
    if table.count() > most:
        texts = docs.select(text_key().alias("key"), text_or_empty().alias("text"))
        found = joined_features(texts.dropDuplicates(["key"]), table).toDF("_text_key", name)
        joined = docs.join(found.hint("merge"), text_key(docs["text"]) == F.col("_text_key"), "left")
        return joined.select(*docs.columns, F.coalesce(name, F.array(*[F.lit(0.0)] * 3)).alias(name))
    got = table.toArrow()
    held = spark.sparkContext.broadcast(Gains(got["k"].to_numpy(), got["gain"].to_numpy()))

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        found = [x for low in range(0, len(text), ROWS) for x in held.value.features(text.iloc[low : low + ROWS].tolist())]
        give_back()
        return pd.Series(found, dtype=object)

    return docs.withColumn(name, features(text_or_empty()))


def learnt(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The gains of the n-grams of all documents, from the class counts of remainders 1 to 3, or None
    where a class has no counts; and the labels that are known.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("class"))
    fold = remainder()
    counted = known.filter((fold > 0) & (fold < 4)).toDF("_labelled", "class")
    side = F.broadcast(counted) if counted.count() <= LABEL_ROWS else counted.hint("merge")
    texts = docs.select(F.col("doc_id").alias("_own"), text_or_empty().alias("text")).join(side, F.col("_own") == F.col("_labelled"), "left")
    exact, path = written(class_grams(texts.select("text", "class")), "exact-grams")
    both = exact.agg(F.max(F.col("toxic") > 0), F.max(F.col("ordinary") > 0)).first()
    table = gains(exact) if all(both) else None
    drop_table(docs.sparkSession, path)
    return table, known


def scored(docs: DataFrame, labels: DataFrame, name: str = "score", calibration: int = CALIBRATION, most: int = MODEL_ROWS) -> DataFrame:
    """The documents with their score as a further column."""
    table, known = learnt(docs, labels)
    if table is None:
        return docs.withColumn(name, F.lit(0.0))
    plain = docs.select("doc_id", "text")
    fold = remainder()
    present = known.filter(fold == 4).join(plain.select("doc_id"), "doc_id", "left_semi")
    sample = present.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(calibration)
    # a row of each text of an id: at most ``calibration`` ids
    fitted = plain.filter(fold == 4).join(F.broadcast(sample), "doc_id").select("class", "text")
    seen = with_features(fitted, table, "_x", most).select("class", F.col("_x").alias("x")).collect()
    toxic = np.array([r["class"] for r in seen], float)
    curve = fitted_curve(np.array([r["x"] for r in seen]), toxic) if len(set(toxic.tolist())) == 2 else PLAIN_CURVE
    out = with_features(docs, table, "_toxic_features", most)
    return out.withColumn(name, on_curve(F.col("_toxic_features"), curve)).drop("_toxic_features")


def rated(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half."""
    return scored(docs, labels, "_toxic_score").filter("_toxic_score < 0.5").select(*docs.columns)
