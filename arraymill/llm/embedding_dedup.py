"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Equal vectors of a label are one node. A label's nodes beyond twice a cell's size are dealt to cells
by spherical k-means, cells that are still too large to cells of their own, and so on; each group's
centres are learnt from a bounded sample of it, in one task, and meet its vectors chunk by chunk, so
nothing that grows with the table goes to the driver or to every executor.

Two unit vectors at the threshold are at most a chord apart, so of a pair whose homes differ at least
one lies within half that chord of the plane between the two centres: a vector visits each cell to
which its plane is as near, and no linked pair is missed. Vectors without clusters lie near many
planes. Where the sample shows that cells would save less than ``WORTH`` of the products, the group
stays one cell; comparing it then costs the square of its size, as exact links of such vectors do.

A cell's vectors are compared in blocks, each pair of blocks in a task; counts and a spanning forest
leave a task, never the pairs. A pair that meets in several cells counts in the least of its homes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing. Vectors of different lengths never link. Rows that repeat are
vectors of their own; a null vec_id is its own component. Columns besides don't matter, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, dealt_blocks, joined_labels, run_ends, whole_groups
from .shared import drop_table, written

THRESHOLD = 0.93
#: Vectors of a group from which its centres are learnt, about.
SAMPLE = 20_000
#: Vectors a cell is meant to hold.
CELL = 2_000
#: Cells that a group is dealt to at once, and levels of cells within cells.
FANOUT = 64
LEVELS = 10
#: Share of the products that cells must leave.
WORTH = 0.75
ROUNDS = 8
BLOCK = 2_048
#: Vectors that are dealt to cells in a task.
CHUNK = 20_000
_SLACK = 1e-9
_TRAIL = "array<struct<cell: int, home: int, visits: array<int>>>"


def centres(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres of spherical k-means over unit vectors; at most k, at least one."""
    rng = np.random.default_rng(seed)
    own = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        cell = np.argmax(sample @ own.T, axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1)
        some = norm > 1e-12
        own = np.where(some[:, None], sums / np.where(some, norm, 1.0)[:, None], own)
    return np.unique(own, axis=0)


def visited(x: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the nearest centre, and whether each cell is visited."""
    near, at = x @ own.T, np.arange(len(x))
    home = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 1e-18))
    visits = (near[at, home][:, None] - near) / apart[home] <= math.sqrt(max(2 - 2 * threshold, 0)) / 2 + _SLACK
    visits[at, home] = True
    return home, visits


def units(col: pa.Array) -> list[bytes | None]:
    """Each list scaled to length one in double precision, as bytes, or None if it can't be compared."""
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out: list[bytes | None] = [None] * len(col)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == dim)
        x = flat[begin[mine][:, None] + np.arange(dim)]
        largest = np.abs(x).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        x = x[good] / largest[good, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for i, row in zip(mine[good].tolist(), x, strict=True):
            out[i] = row.tobytes()
    return out


def unit(values: list | None) -> np.ndarray | None:
    """The vector scaled to length one, or None if it can't be compared."""
    raw = units(pa.array([values], pa.list_(pa.float64())))[0]
    return None if raw is None else np.frombuffer(raw)


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), dim)


def cells(nodes: DataFrame, threshold: float, sample: int, cell: int, block: int) -> DataFrame:
    """The nodes in each cell that they visit: ``path`` tells cells of a label apart, ``trail`` has the levels'
    cells, with the node's home and visits. From rows of ``label, dim, node, m, unit``.
    """
    label, group = nodes.schema["label"].dataType.simpleString(), ["label", "dim", "path"]
    points = nodes.select("label", "dim", F.lit(0).cast("bigint").alias("path"), "node", "m", "unit", F.array().cast(_TRAIL).alias("trail"))
    schema, done, paths = points.schema, [], []

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, x = int(rows["n"].iloc[0]), _matrix(rows["unit"].tolist(), key[1])
        own = centres(x, min(FANOUT, math.ceil(n / cell)))
        share = visited(x, own, threshold)[1].mean(axis=0)
        moved = (share * np.ceil(share * n / block)).sum()
        useful = len(own) > 1 and (share**2).sum() <= WORTH and moved <= 2 * math.ceil(n / block)
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "path": [key[2]], "n": [n], "centres": [own.tobytes() if useful else None]})

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{c: left.column(c).slice(0, 0) for c in ("label", "dim", "path", "node", "m", "unit", "trail")}, "cell": pa.array([], pa.int32())})
        dim = left.column("dim")[0].as_py()
        own = np.frombuffer(right.column("centres")[0].as_py()).reshape(-1, dim)
        home, visits = visited(_matrix(left.column("unit").to_pylist(), dim), own, threshold)
        i, c = np.nonzero(visits)
        before, lists = left.column("trail").to_pylist(), [np.flatnonzero(v).tolist() for v in visits]
        trail = [[*before[a], {"cell": b, "home": h, "visits": lists[a]}] for a, b, h in zip(i.tolist(), c.tolist(), home[i].tolist(), strict=True)]
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("home", pa.int32()), ("visits", pa.list_(pa.int32()))]))
        at = pa.array(i)
        return pa.table({**{f: left.column(f).take(at) for f in ("label", "dim", "path", "node", "m", "unit")}, "trail": pa.array(trail, kind), "cell": pa.array(c.astype(np.int32))})

    for _ in range(LEVELS):
        big = points.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cell)
        picked = points.join(big, group).filter(F.pmod(F.xxhash64("unit", "path"), F.lit(1 << 30)) < sample / F.col("n") * (1 << 30))
        books = picked.groupBy(*group).applyInPandas(learn, f"label {label}, dim int, path bigint, n bigint, centres binary")
        books, books_at = written(books, "vector-centres")
        books = books.filter("centres is not null")
        if books.isEmpty():
            drop_table(nodes.sparkSession, books_at)
            break
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        left = points.join(books.select(*group, "n"), group).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), chunks).cast("int")).drop("n")
        right = books.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        by = [*group, "chunk"]
        placed = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(deal, f"label {label}, dim int, path bigint, node bigint, m bigint, unit binary, trail {_TRAIL}, cell int")
        placed, path = written(placed.withColumn("path", F.xxhash64("path", "cell")).select(*schema.names), "vector-cells")
        rest, rest_path = written(points.join(books.select(*group), group, "left_anti"), "vector-cells")
        done.append(rest)
        drop_table(nodes.sparkSession, books_at)
        if paths:
            drop_table(nodes.sparkSession, paths.pop())
        paths.append(path)
        points = placed
    for rest in done:
        points = points.unionByName(rest)
    return points


def links(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    label, kind = (vectors.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_pylist()
            own = [u if k else None for u, k in zip(units(batch.column(2)), known, strict=True)]
            dims = pa.array([len(u) // 8 if u is not None else 0 for u in own], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), dims, pa.array(own, pa.binary())], names=["vec_id", "label", "row", "dim", "unit"])

    rows = rows.mapInArrow(scaled, f"vec_id {kind}, label {label}, row bigint, dim int, unit binary")
    rows, rows_at = written(rows.withColumn("same", F.md5("unit")), "vectors")
    equal = ["label", "dim", "same"]
    nodes = rows.filter("dim > 0").groupBy(*equal).agg(F.min(F.struct("row", "unit")).alias("head"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    nodes, nodes_at = written(nodes.select(*equal, F.col("head.row").alias("node"), "m", "least", F.col("head.unit").alias("unit")), "vector-nodes")
    placed = cells(nodes.select("label", "dim", "node", "m", "unit"), threshold, sample, cell, block)
    group = ["label", "dim", "path"]
    sizes = placed.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
    members = dealt_blocks(placed.join(sizes, group), "n", block, "node", *group)
    members = members.select("task", "dim", "node", "m", "trail", "own", "low", "high", "unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            task, dims, node, m, sides, low, high = (table.column(c).to_numpy() for c in ("task", "dim", "node", "m", "own", "low", "high"))
            raw, trail = table.column("unit").to_pylist(), table.column("trail")
            ends, out = run_ends(task), []
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                x = _matrix(raw[a:b], int(dims[a]))
                if low[a] == high[a]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    one, two = np.flatnonzero(sides[a:b] == low[a]), np.flatnonzero(sides[a:b] == high[a])
                    i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                    i, j = one[i], two[j]
                for level in zip(*trail.slice(a, b - a).to_pylist(), strict=True) if len(i) else ():
                    # a pair that meets in both homes counts in the smaller one
                    home, visits = np.array([s["home"] for s in level]), np.zeros((b - a, FANOUT), bool)
                    for k, s in enumerate(level):
                        visits[k, s["visits"]] = True
                    there = np.minimum(np.where(visits[j, home[i]], home[i], FANOUT), np.where(visits[i, home[j]], home[j], FANOUT))
                    i, j = i[there == level[0]["cell"]], j[there == level[0]["cell"]]
                if not len(i):
                    continue
                n = np.bincount(i, m[a:b][j], minlength=b - a) + np.bincount(j, m[a:b][i], minlength=b - a)
                labels = joined_labels(np.arange(b - a), i, j)
                away, some = np.flatnonzero(labels != np.arange(b - a)), np.flatnonzero(n)
                out += [(0, node[a + away], node[a + labels[away]]), (1, node[a + some], n[some])]
            if out:
                kinds = np.concatenate([np.full(len(u), k, np.int32) for k, u, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([u for _, u, _ in out])), pa.array(np.concatenate([v for _, _, v in out]).astype(np.int64))], names=["kind", "u", "v"])

    found = members.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "kind int, u bigint, v bigint")
    found, found_at = written(found, "vector-links")
    joined = components(found.filter("kind = 0")).withColumnRenamed("component", "root")
    counts = found.filter("kind = 1").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("beyond"))
    known = nodes.drop("unit").join(counts, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", F.when(F.col("m") > 1, F.col("node"))))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least.filter("root is not null"), "root", "left").select(*equal, (F.coalesce("beyond", F.lit(0)) + F.col("m") - 1).alias("n"), "component")
    out = rows.select("vec_id", *equal).join(known, equal, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    result, _ = written(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-classes")
    for path in (rows_at, nodes_at, found_at):
        drop_table(spark, path)
    return result


def representatives(vectors: DataFrame, **options) -> DataFrame:
    """The vectors that stand for their group."""
    kept = links(vectors, **options).filter("kept").select(F.col("vec_id").alias("_kept_id")).distinct()
    return vectors.join(kept, vectors["vec_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
