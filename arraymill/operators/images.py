"""Thresholds, exceedances, clusters and centroids of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.cut import cut
from ..plans.ordered import ranked
from .grid import Grid


def apply_threshold(x: Grid, threshold: float) -> Grid:
    return x.map(lambda v: v > threshold)


def generate_threshold(x: Grid, rate: float) -> float:
    """The least whole value that at most a share ``rate`` of the pixels reaches or exceeds.

    The histogram of floors has a row for each distinct value and is summed from the top.
    """
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies in 0 to 1")
    counts = x.df.groupBy(F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("v")))
    hit = counts.withColumn("s", above / x.size).filter(F.col("s") <= rate).agg(F.min("v")).first()[0]
    return float(hit) if hit is not None else float(counts.agg(F.max("v")).first()[0]) + 1


def window_exceedances(mask: Grid, width: int, compat: bool = False) -> Grid:
    """The mask grown by a border in all eight directions; with compat, of one pixel whatever the width."""
    w = min(width, 1) if compat else width
    spread = mask.df.filter("value").withColumn("_r", F.explode(F.sequence(F.lit(-w), F.lit(w)))).withColumn("_c", F.explode(F.sequence(F.lit(-w), F.lit(w))))
    near = spread.select((F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col")).distinct().withColumn("_hit", F.lit(True))
    return Grid(mask.df.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.coalesce("_hit", F.lit(False)).alias("value")), mask.rows, mask.cols)


#: Pixels along each side of a tile that one task labels.
TILE = 512


def _tile_labels(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each pixel, in order of rows and columns, the number of the first one of its group."""
    n, width = len(row), int(col.max()) - int(col.min()) + 3
    place = (row - row.min()) * width + (col - col.min() + 1)
    pairs = []
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(place, place + step)
        hit = np.flatnonzero((at < n) & (place[np.minimum(at, n - 1)] == place + step))
        pairs.append(np.column_stack([hit, at[hit]]))
    links = np.concatenate(pairs)
    root = np.arange(n)
    while len(links):
        low, high = root[links].min(axis=1), root[links].max(axis=1)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        links = links[root[links[:, 0]] != root[links[:, 1]]]
    return root


def cluster_pixels(x: Grid, mask: Grid, tile: int = TILE) -> DataFrame:
    """``cluster, row, col, intensity``: eight-connected groups of pixels in the mask.

    A task labels the groups inside a tile; links between pixels on both sides of a tile's border then join
    labels, in rounds that touch these links only. Clusters are numbered in order of their first pixels.
    """
    pixels = mask.df.filter("value").select("row", "col")
    cols = x.cols

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["row", "col"], ignore_index=True)
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        first = _tile_labels(row, col)
        return pd.DataFrame({"p": row * cols + col, "row": row, "col": col, "label": (row * cols + col)[first]})

    at = lambda c: F.call_function("div", F.col(c), F.lit(tile).cast("long"))
    labels = cut(pixels.groupBy(at("row").alias("tr"), at("col").alias("tc")).applyInPandas(run, "p long, row long, col long, label long"))
    outer = (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)
    border = labels.filter(outer)
    # half of the eight directions: the other half finds the same links
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reach = border.withColumn("s", F.explode(steps)).select(F.col("label").alias("u"), (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    links = reach.join(border.select("row", "col", F.col("label").alias("v")), ["row", "col"]).filter("u <> v").select("u", "v").distinct()
    joined = labels.join(components(links), F.col("label") == F.col("node"), "left").select("row", "col", F.coalesce("root", "label").alias("label"))
    numbered = ranked(joined.select("label").distinct(), "label", name="cluster")
    values = x.df.select("row", "col", F.col("value").alias("intensity"))
    return joined.join(numbered, "label").join(values, ["row", "col"]).select("cluster", "row", "col", "intensity")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """Extent, size, intensity, peak and energy on detector of each cluster."""
    v = F.col("intensity")
    return clusters.groupBy("cluster").agg(
        F.count("*").alias("size"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
        (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.sum(v).alias("intensity"), F.max(v).alias("peak"), (F.max(v) / F.sum(v)).alias("eod"),
    )


def centroid_clusters(clusters: DataFrame) -> DataFrame:
    """Intensity-weighted centre and ellipse of each cluster, in the clusters' order."""
    v, r, c = F.col("intensity"), F.col("row"), F.col("col")
    mean: Column = lambda e: F.sum(v * e) / F.sum(v)
    sums = clusters.groupBy("cluster").agg(mean(r).alias("row"), mean(c).alias("col"), F.sum(v).alias("intensity"), (F.max(v) / F.sum(v)).alias("eod"), mean(r * r).alias("_rr"), mean(c * c).alias("_cc"), mean(r * c).alias("_rc"))
    m20, m02, m11 = F.col("_cc") - F.col("col") ** 2, F.col("_rr") - F.col("row") ** 2, F.col("_rc") - F.col("row") * F.col("col")
    half, gap = (m20 + m02) / 2, F.sqrt(4 * m11 * m11 + (m20 - m02) * (m20 - m02)) / 2
    big, small = F.greatest(half + gap, F.lit(0.0)), F.greatest(half - gap, F.lit(0.0))
    shape = sums.withColumn("a", 2 * F.sqrt(big)).withColumn("b", 2 * F.sqrt(small)).withColumn("orientation", F.atan2(2 * m11, m20 - m02) / 2)
    eccentricity = F.when(F.col("a") > 0, F.sqrt(1 - F.col("b") * F.col("b") / (F.col("a") * F.col("a")))).otherwise(0.0)
    return shape.withColumn("eccentricity", eccentricity).drop("_rr", "_cc", "_rc")


def generate_centroids(x: Grid, rate: float, window: str = "pre", border: int = 0) -> DataFrame:
    """Threshold, mask, grow before ("pre") or after ("post") clustering, cluster and centre."""
    mask = apply_threshold(x, generate_threshold(x, rate))
    if window == "pre":
        return centroid_clusters(cluster_pixels(x, window_exceedances(mask, border)))
    clusters = cluster_pixels(x, mask)
    if not border:
        return centroid_clusters(clusters)
    grown = clusters.withColumn("_r", F.explode(F.sequence(F.lit(-border), F.lit(border)))).withColumn("_c", F.explode(F.sequence(F.lit(-border), F.lit(border))))
    grown = grown.select("cluster", (F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col")).distinct()
    own = x.df.select("row", "col", F.col("value").alias("intensity"))
    return centroid_clusters(grown.join(own, ["row", "col"]))
