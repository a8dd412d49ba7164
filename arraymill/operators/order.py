"""Sorting, selection by rank, sets, counting and binning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.asof import bracket
from ..plans.ordered import ranked
from ..plans.select import ranks
from .grid import Axis, Grid


def argsort(x: Grid, axis: Axis = Axis.NONE) -> Grid:
    """Positions in rising order of value, the first of equals first."""
    if axis is Axis.NONE:
        rows = ranked(x.df.select(x.idx.alias("_at"), "value"), "value", "_at", name="_rank")
        return Grid(rows.select(F.lit(0).cast("long").alias("row"), F.col("_rank").alias("col"), F.col("_at").alias("value")), 1, x.size)
    c, k = axis.along[0], axis.keys[0]
    rank = (F.row_number().over(Window.partitionBy(k).orderBy("value", c)) - 1).cast("long")
    rows = x.df.withColumn("_rank", rank).select(F.col(k), F.col("_rank").alias("_c"), F.col(c).alias("value")).withColumnRenamed("_c", c)
    return Grid(rows.select("row", "col", "value"), x.rows, x.cols)


def sort(x: Grid, axis: Axis = Axis.NONE) -> Grid:
    if axis is Axis.NONE:
        rows = ranked(x.df, "value", "row", "col", name="_rank")
        return Grid(rows.select(F.lit(0).cast("long").alias("row"), F.col("_rank").alias("col"), "value"), 1, x.size)
    c, k = axis.along[0], axis.keys[0]
    rank = (F.row_number().over(Window.partitionBy(k).orderBy("value", c)) - 1).cast("long")
    return Grid(x.df.withColumn("_rank", rank).drop(c).withColumnRenamed("_rank", c).select("row", "col", "value"), x.rows, x.cols)


def partition(x: Grid, kth: int, axis: Axis = Axis.NONE) -> Grid:
    """A full order, in which the value of rank kth is in its place as any partition has it."""
    if not 0 <= kth < x.dim_size(Axis.NONE if axis is Axis.NONE else axis):
        raise ValueError("kth is out of range")
    return sort(x, axis)


#: Rank or ranks between which each mode of a percentile lies, of n values at p per cent.
MODES: dict[str, Callable[[Column, float], list[Column]]] = {
    "linear": lambda n, p: [F.floor((n - 1) * (p / 100)), F.ceil((n - 1) * (p / 100))],
    "lower": lambda n, p: [F.floor((n - 1) * (p / 100))],
    "higher": lambda n, p: [F.ceil((n - 1) * (p / 100))],
    "nearest": lambda n, p: [F.rint((n - 1) * (p / 100))],
    "midpoint": lambda n, p: [F.floor((n - 1) * (p / 100)), F.ceil((n - 1) * (p / 100))],
}


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], mode: str = "linear") -> DataFrame:
    """``keys`` and, for each name, a percentile of the group's values; groups of any size, all at once."""
    if mode not in MODES:
        raise ValueError(f"no interpolation named {mode}")
    if any(not 0 <= p <= 100 for p in wanted.values()):
        raise ValueError("a percentile lies in 0 to 100")
    sides = {f"_{name}_{i}": (lambda n, p=p, i=i: MODES[mode](n, p)[i]) for name, p in wanted.items() for i in range(len(MODES[mode](F.lit(1), p)))}
    found = ranks(df, keys, value, sides, count="_n")

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_{len(MODES[mode](F.lit(1), p)) - 1}")
        part = (F.col("_n") - 1) * (p / 100)
        share = part - F.floor(part) if mode == "linear" else F.lit(0.5)
        return F.when(low == high, low).otherwise(low + (high - low) * share)

    return found.select(*keys, *[between(name, p).alias(name) for name, p in wanted.items()])


def percentile(x: Grid, p: float, axis: Axis = Axis.NONE, mode: str = "linear", nan_safe: bool = False) -> DataFrame:
    """p-th percentile with linear, lower, higher, nearest or midpoint interpolation."""
    df = x.df.filter(~F.isnan("value")) if nan_safe else x.df
    return percentiles(df, axis.keys, "value", {"value": p}, mode)


def nanmedian(x: Grid, axis: Axis = Axis.NONE) -> DataFrame:
    """Of n numbers in order the one of index n // 2: the upper middle, without averaging."""
    return ranks(x.df.filter(~F.isnan("value")), axis.keys, "value", {"value": lambda n: F.floor(n / 2)})


def nth_element(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``keys, value``: the value that is n-th, from 0, of each group in rising order, null where there are fewer."""
    return ranks(df, keys, value, {"value": lambda _: F.lit(n)})


def _line(values: DataFrame) -> DataFrame:
    return ranked(values, "value", name="col").select(F.lit(0).cast("long").alias("row"), "col", "value")


def unique(x: Grid, epsilon: float = 2.0**-52) -> DataFrame:
    """Distinct values in order; a value within a relative epsilon of the one before it is the same."""
    rows = ranked(x.df.select("value").distinct(), "value", name="col")
    before = rows.select((F.col("col") + 1).alias("col"), F.col("value").alias("_before"))
    same = F.abs(F.col("value") - F.col("_before")) <= F.least(F.abs("value"), F.abs("_before")) * epsilon
    kept = rows.join(before, "col", "left").filter(F.col("_before").isNull() | ~same).select("value")
    return _line(kept)


def union1d(a: Grid, b: Grid) -> DataFrame:
    return _line(a.df.select("value").union(b.df.select("value")).distinct())


def intersect1d(a: Grid, b: Grid) -> DataFrame:
    return _line(a.df.select("value").intersect(b.df.select("value")))


def setdiff1d(a: Grid, b: Grid) -> DataFrame:
    return _line(a.df.select("value").subtract(b.df.select("value")))


def bincount(x: Grid, weights: Grid | None = None, min_length: int = 1) -> DataFrame:
    """``col, value``: occurrences (or weights) of 0, 1, ... up to the largest value; negatives count as 0."""
    rows = x if weights is None else x.zip(weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    v = F.col("value") if weights is None else F.col("value.v")
    amount = F.count("*") if weights is None else F.sum("value.w")
    counts = rows.df.groupBy(F.greatest(v, F.lit(0)).cast("long").alias("col")).agg(amount.alias("value"))
    top = counts.agg(F.greatest(F.coalesce(F.max("col"), F.lit(0)), F.lit(min_length - 1).cast("long")).alias("top"))
    bins = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("col"))
    zero = F.lit(0 if weights is None else 0.0)
    return bins.join(counts, "col", "left").select("col", F.coalesce("value", zero).alias("value"))


def digitize(v: Column, edges: list[float]) -> Column:
    """Number of distinct sorted edges at or below the value; edges are a driver-side list of bounded length."""
    own = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
    return F.when(F.isnan(v), F.lit(len(set(edges)))).otherwise(F.size(F.filter(own, lambda e: e <= v)))


def histogram(x: Grid, edges: list[float]) -> DataFrame:
    """``bin, low, high, value``: counts between edges, the last bin closed."""
    own = sorted({float(e) for e in edges})
    n = len(own) - 1
    v = F.col("value")
    at = F.when(v == own[-1], F.lit(n - 1)).otherwise(digitize(v, own) - 1)
    counts = x.df.filter((v >= own[0]) & (v <= own[-1])).groupBy(at.alias("bin")).agg(F.count("*").alias("value"))
    bins = x.df.sparkSession.createDataFrame([(i, own[i], own[i + 1]) for i in range(n)], "bin int, low double, high double")
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", "low", "high", F.coalesce("value", F.lit(0)).alias("value"))


def histogram_bins(x: Grid, n: int) -> DataFrame:
    """Counts in n equal bins from the least to the greatest value, the last bin closed."""
    low, high = x.df.agg(F.min("value"), F.max("value")).first()
    return histogram(x, [low + (high - low) * i / n for i in range(n)] + [high])


def digitize_by(x: Grid, edges: DataFrame) -> Grid:
    """Number of distinct edges at or below each value; edges are a table's column ``edge`` of any length.

    NaN is above all edges, null has none at or below it.
    """
    met = bracket(x.df.withColumnRenamed("value", "edge"), edges.select(F.col("edge").cast("double").alias("edge")).distinct(), "edge")
    return Grid(met.select("row", "col", F.col("edges").alias("value")), x.rows, x.cols)


def histogram_by(x: Grid, edges: DataFrame) -> DataFrame:
    """``bin, low, high, value``: counts between the distinct edges of a table's column ``edge``, the last bin closed."""
    own = edges.select(F.col("edge").cast("double").alias("edge")).filter(F.col("edge").isNotNull() & ~F.isnan("edge")).distinct()
    bins = ranked(own, "edge", name="bin")
    n = bins.count() - 1
    after = bins.select((F.col("bin") - 1).alias("bin"), F.col("edge").alias("high"))
    bins = bins.withColumnRenamed("edge", "low").join(after, "bin")
    met = bracket(x.df.select(F.col("value").cast("double").alias("edge")), own, "edge").filter(F.col("below").isNotNull())
    # at the last edge the count is that of all edges, beyond it there is no edge above either
    last = (F.col("edges") > n) & (F.col("edge") == F.col("below.edge"))
    counts = met.filter(F.col("above").isNotNull() | last).groupBy((F.least("edges", F.lit(n)) - 1).alias("bin")).agg(F.count(F.lit(1)).alias("value"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("value", F.lit(0)).alias("value"))


def interp(x: Grid, points: DataFrame) -> Grid:
    """Linear interpolation at each value between known ``xp, fp`` points; outside them an error.

    One ordered pass over values and points together, so neither side's size or spread matters.
    """
    known = points.select(F.col("xp").cast("double").alias("xp"), F.col("fp").cast("double").alias("fp"))
    met = bracket(x.df.withColumn("xp", F.col("value").cast("double")), known, "xp")
    x0, f0, x1, f1 = F.col("below.xp"), F.col("below.fp"), F.col("above.xp"), F.col("above.fp")
    share = (F.col("xp") - x0) / (x1 - x0)
    value = F.when(F.col("xp") == x0, f0).when(x0.isNotNull() & x1.isNotNull(), f0 * (1 - share) + f1 * share)
    outside = F.when(F.col("value").isNotNull(), F.raise_error(F.lit("a value lies outside the points")).cast("double"))
    return Grid(met.select("row", "col", F.coalesce(value, outside).alias("value")), x.rows, x.cols)
