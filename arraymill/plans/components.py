"""Connected components of a graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``u, v`` edges between different nodes; the root is its smallest node.

    A round ties a node's larger neighbours, then its smaller ones, to the least of its neighbourhood. Each
    round is kept, and their number follows the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = tied.groupBy("u").agg(F.min("v").alias("m"))
        rest = tied.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(rest.unionByName(low.toDF("u", "v")).distinct())
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.toDF("node", "root").unionByName(roots)
