"""Connected components of a distributed graph by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, written


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for each node with an edge to another; component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the least of its
    neighbourhood, until the graph is a forest of stars. Rounds grow with the logarithm of the
    longest path. A round's edges are a written table, and the one before goes. No edges, or loops
    only: an empty result.
    """
    start = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    now, path = written(start, "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, new_path = written(small.unionByName(least.toDF("u", "v")).distinct(), "stars")
        new_mark = _mark(following)
        drop_table(now.sparkSession, path)
        same, now, path, mark = new_mark == mark, following, new_path, new_mark
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i[k] with j[k]: the smallest row index of each local component."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the key column; the last group waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        new = held and held[-1].column(key)[-1].as_py() != k[0]
        last = int(np.flatnonzero(k == k[-1])[0])
        if new:
            if last:
                held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        elif last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def run_ends(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys ends."""
    return np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1


def dealt_blocks(rows: DataFrame, members: str, block: int, row: str, *group: str) -> DataFrame:
    """Rows with their group's ``task``; in a group beyond the block size, once for each pair of blocks
    that theirs is in. ``own`` is a row's block, ``low`` and ``high`` the pair. members: the group's size.
    """
    n = F.ceil(F.col(members) / block)
    own = F.pmod(F.xxhash64(row, F.lit(3)), n)
    rows = rows.withColumn("blocks", n).withColumn("own", own.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("low", low).withColumn("high", high).withColumn("task", F.xxhash64(*group, "low", "high"))
