"""What each filter of a chain removes in every order of the chain, alone and together with the others.

Documents become failure masks, one bit a filter, and are counted by part and mask before anything is
spread out: from there on the work depends on the parts and the filters, not on the documents. A mask's
cell is unpivoted against the steps of all orders; a running bit-or over the filters before a step tells
what an earlier one removed; conditional sums give the figures of a step, and a filter's total over all
orders is a window over the filter's steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty

BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2


def conditions(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text: few words, few distinct words (per cent), many capitals
    (per cent of the characters), signs."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part: Column, tests: Mapping[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """``doc_id, part, mask, good, toxic``: bit i of the mask is set where the document fails filter i.

    ``tests`` are failure conditions over a text column named ``text``, by letter; the filter ``repeats``,
    which comes last, fails a document whose text a smaller doc_id has, anywhere in the table. Texts are
    identical where their SHA-256 digests are. Only digests are shuffled, counted before that.
    """
    own = docs.select("doc_id", part.alias("part"), text_or_empty(docs["text"]).alias("text"))
    tests = conditions(F.col("text")) if tests is None else dict(tests)
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(tests.values())]
    flat = own.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    first = flat.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    again = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(bits))).otherwise(F.lit(0))
    marked = flat.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    return marked.join(known, "doc_id", "left").select("doc_id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def audit(marked: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step`` and the figures of the step, for every order of the filters.

    ``kept`` documents pass it and all before it, ``removed`` fail it first, ``redundant`` fail it when an
    earlier one has removed them, ``unique_fails`` fail no other filter; ``good_lost`` and ``toxic_lost``
    are the good and the toxic ones of the removed; ``shapley`` is what its filter removes in all orders.
    A part has as many rows as orders have steps, so the number of filters must be small.
    """
    cells = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.array(*[F.substring("filter_order", i + 1, 1) for i in range(len(filters))])).alias("at", "letter"))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("letter")) - 1)
    steps = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    ahead = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(ahead), F.lit(0)))
    fails, fresh = F.col("fails") != 0, F.col("earlier") == 0
    total = lambda where, n="n": F.sum(F.when(where, F.col(n)).otherwise(F.lit(0))).cast("long")
    figures = seen.groupBy("part", "filter_order", "at", "letter").agg(
        total(~fails & fresh).alias("kept"), total(fails & fresh).alias("removed"), total(fails & ~fresh).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & fresh, "n_good").alias("good_lost"), total(fails & fresh, "n_toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return figures.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def interactions(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """The audit of the five usual filters, A to D of ``conditions`` and E for repeated texts, by source.

    Defined results: a null text is an empty one, a null part the empty string, a document without labels
    is neither good nor toxic, and one with several is what any of them says. A null doc_id comes after
    no other, so its text is never a repeat; rows of one doc_id don't repeat each other. Texts of any
    length are read whole. No documents: no rows. Other columns don't matter, whatever their names.
    """
    return audit(masks(docs, labels, docs["source"] if part is None else part))
