"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source with target T and size S should be taken T/S times on average. The whole part
of that ratio is taken outright; the fraction is an inclusion probability. Cube sampling turns the
fractions of a source into zeros and ones while keeping both the words and the number of documents:
each step picks one more undecided document than there are constraints, finds a vector of the
constraints' null space and moves the probabilities along it until one of them is 0 or 1. The flight
runs in blocks of a source, whose few undecided documents go on to the next, smaller round of blocks
until one block a source is left. The landing decides at most two documents a source, often its
largest, which move least; what is short or over then is made up for by other documents of the block,
the largest that fit first.

Defined results: a null text has size 0; sizes 0 are taken 0 words whatever their copies. Sources
run in order of code points with null last. Rows that agree in id, text and source are one unit, whose
copies they share evenly. A text of any length is one row's work. Columns besides don't matter,
whatever their names. An empty table gives an empty result. The order of flight hangs on
hashes of the rows alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, text_key, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK = 4096
#: Blocks of a source that meet in one block of the next round.
FAN_IN = 512
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, source_size``, one a source.

    With weight w and cap c = most * size, water-filling gives min(c, w * t) for the one level t at
    which the targets add up to the total; running sums over sources in order of c / w find it.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.partitionBy(F.lit(0)).orderBy("level", "place")
    to_here, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("level", F.col("cap") / F.col("w"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(to_here), F.lit(0.0)))
        .withColumn("t", (F.col("total") - F.col("capped")) / F.sum("w").over(after))
    )
    # the first source in this order whose own cap isn't reached sets the level
    level = F.min(F.when(F.col("t") <= F.col("level"), F.struct("level", "place", "t"))).over(everything)["t"]
    return rows.withColumn("at", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("at"), F.col("cap"))).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping the sums of pi and of pi * size; at most 2 stay between."""
    pi = pi.copy()
    open_ = [i for i in range(len(pi)) if _EPS < pi[i] < 1 - _EPS]
    scale = max(1.0, float(size.max(initial=1)))
    x = (size / scale).tolist()
    p = pi.tolist()
    hand, nxt = open_[:3], 3
    while len(hand) == 3:
        a, b, c = hand
        # null space of the two constraints: the cross product of (1, 1, 1) and (xa, xb, xc)
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if max(map(abs, u)) < 1e-15:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u, strict=True) if v)
        # the draw that keeps each expectation, settled by a hash of the step in place of chance
        draw = (((nxt * 2654435761 + len(p) * 40503) ^ (a * 2246822519)) % 4294967291) / 4294967291
        move = up if draw < down / (up + down) else -down
        for i, v in zip(hand, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + move * v))
        hand = [i for i in hand if _EPS < p[i] < 1 - _EPS]
        while len(hand) < 3 and nxt < len(open_):
            hand.append(open_[nxt])
            nxt += 1
    out = np.array(p)
    return np.where(out < _EPS, 0.0, np.where(out > 1 - _EPS, 1.0, out))


def land(pi: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Decide what the flight of a block has left: the choice whose words come nearest to those that the
    probabilities ``before`` the flight ask for, once other documents have made up for what it lacks.
    """
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    want, free = float((before * size).sum()), np.argsort(-size, kind="stable")
    free = free[(before[free] > 0) & (size[free] > 0) & ((pi[free] == 0) | (pi[free] == 1))]
    best: tuple[float, float, int, np.ndarray] | None = None
    for choice in range(1 << len(open_)):
        out = pi.copy()
        out[open_] = [choice >> i & 1 for i in range(len(open_))]
        short = want - float((out * size).sum())
        for i in free.tolist():
            if out[i] == (short < 0) and size[i] <= abs(short):
                short += size[i] * (1 if out[i] else -1)
                out[i] = 1 - out[i]
        key = (abs(short), abs(float(out.sum() - before.sum())), choice)
        if best is None or key < best[:3]:
            best = (*key, out)
    return best[3]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, share: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row a document: ``doc_id, text_key, size, source, source_size, target, copies, taken``."""
    rows = docs.select("doc_id", "source", text_key().alias("text_key"), word_count(text_or_empty()).alias("size"))
    rows, rows_at = written(rows, "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).drop("docs"), weights, most, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("rows"))
    docs_of = same.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("source_docs"))
    known = aims.join(docs_of, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    wanted = F.col("rows") * ratio
    units = (
        same.join(known, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        # a number of copies that is whole but for rounding is so
        .withColumn("whole", F.floor(wanted + _EPS).cast("long"))
        .withColumn("pi", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wanted - F.col("whole"))).otherwise(0.0))
        .withColumn("order", F.xxhash64("doc_id", "text_key"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / block)).cast("long"))
        .drop("source_docs")
    )
    columns = units.columns

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "size"], kind="stable", na_position="first")
        before, size = group["pi"].to_numpy(float), group["size"].to_numpy(float)
        pi = flight(before, size)
        # the last block of a source
        group["pi"] = land(pi, size, before) if group["blocks"].iloc[0] == 1 else pi
        return group[columns]

    settled = []
    spread = F.pmod(F.xxhash64("order", F.lit(7)), F.col("blocks"))
    left = units.withColumn("cell", spread)
    while True:
        most_blocks = left.agg(F.max("blocks")).first()[0] or 1
        flown = left.groupBy("source", "cell").applyInPandas(fly, units.schema)
        flown, _ = written(flown, "mix-flight")
        if most_blocks == 1:
            settled.append(flown)
            break
        between = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(flown.filter(~between))
        left = flown.filter(between).withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN).cast("long")).withColumn("cell", spread)
    drop_table(docs.sparkSession, rows_at)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.withColumn("all", F.col("whole") + F.round("pi").cast("long")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.floor(F.col("all") / F.col("rows")) + (F.col("nth") <= F.col("all") % F.col("rows")).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "text_key", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Rows that agree in id, text and source share their copies evenly, the first ones getting the rest.
    """
    same = ["doc_id", "text_key", "source"]
    chosen = mix(docs, **options).groupBy(*same).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    chosen = chosen.toDF(*"_mix_d _mix_k _mix_s _mix_copies _mix_rows".split())
    met = docs["doc_id"].eqNullSafe(chosen["_mix_d"]) & (text_key(docs["text"]) == chosen["_mix_k"]) & docs["source"].eqNullSafe(chosen["_mix_s"])
    joined = docs.join(chosen, met)
    single = joined.filter("_mix_rows = 1").withColumn("_mix_mine", F.col("_mix_copies"))
    nth = F.row_number().over(Window.partitionBy("_mix_d", "_mix_k", "_mix_s").orderBy("_mix_d"))
    several = joined.filter("_mix_rows > 1").withColumn("_mix_mine", F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (nth <= F.col("_mix_copies") % F.col("_mix_rows")).cast("long"))
    out = single.unionByName(several).filter("_mix_mine > 0")
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_mine")))).select(*docs.columns)
