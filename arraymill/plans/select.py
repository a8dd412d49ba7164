"""Values of given ranks in every group at once, without holding or sorting a group.

A first pass counts each group and summarises it by values at even steps of rank, in a fixed size that
tasks merge. The wanted rank then lies between two of those values; a pass counts the rows below and in
that bracket and, as long as it has many, summarises it in turn. In a bracket of few rows the occurrences of each
value are counted, and the running count finds the rank. A pass leaves a thirtieth of the rows in the
bracket, so two passes do for millions of rows a group and a third for hundreds of millions; rows that
share a value count as one where they are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

#: Rows of a bracket whose values are counted one by one; more are bracketed again.
FEW = 100_000
#: Steps of a summary. Its error is an eighth of a step at most, and a bracket has three or four.
STEPS = 128


def ranks(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], few: int = FEW, count: str | None = None) -> DataFrame:
    """``keys`` and, for each name wanted, the value of a 0-based rank in the group's rising order.

    ``wanted`` gives the rank for a group's number of values; out of range it gives null. Null values
    don't count, NaN is the largest. Groups may be of any size, and null is a key like another. ``count``
    names a column for the group's number of values.
    """
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).filter("_v IS NOT NULL")
    real = F.when(~F.isnan("_v"), F.col("_v"))
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(real).alias("_inside"), _grid(real)))
    names = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in wanted.items()])
    asked = sizes.withColumn("_w", F.explode(names)).select(*sizes.columns, F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
    found = asked.filter((F.col("_rank") >= F.col("_inside")) & (F.col("_rank") < F.col("_n"))).select(*keys, "_name", F.lit(float("nan")).alias("_found"))
    everything = {"_from": F.lit(float("-inf")), "_to": F.lit(float("inf"))}
    open_, rows = asked.filter((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_inside"))).drop("_n").withColumns(everything), rows.filter(~F.isnan("_v"))
    while True:
        # a group that is small as it is needs no bracket
        small = F.col("_inside") <= few
        tight = _tight(open_).withColumns({"_low": F.when(small, F.col("_from")).otherwise(F.col("_low")), "_high": F.when(small, F.col("_to")).otherwise(F.col("_high"))})
        soon = small | (F.col("_inside") * 4 <= few * STEPS)
        n = tight.agg(F.count_if(soon).alias("soon"), F.count_if(~soon).alias("later")).first()
        if n["soon"]:
            found = found.unionByName(_counted(rows, tight.filter(soon), keys))
        if not n["later"]:
            break
        open_ = cut(_narrowed(rows, tight.filter(~soon), keys))
        settled = F.col("_from") == F.col("_to")
        found = found.unionByName(open_.filter(settled).select(*keys, "_name", F.col("_from").alias("_found")))
        open_ = open_.filter(~settled)
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in wanted])
    kept = sizes.select(*keys, *([F.col("_n").alias(count)] if count else []))
    whole = _meet(kept, picked, keys, "left") if keys else kept.join(F.broadcast(picked))
    return whole.select(*kept.columns, *wanted)


def _grid(v: Column) -> Column:
    """Values at even steps of rank, each off by an eighth of a step at most, and the extremes."""
    inner = F.percentile_approx(v, [i / STEPS for i in range(1, STEPS)], 8 * STEPS)
    return F.concat(F.array(F.min(v)), inner, F.array(F.max(v))).alias("_grid")


def _tight(open_: DataFrame) -> DataFrame:
    """The grid's values around each rank as ``_low`` and ``_high``, a step or more away."""
    share = (F.col("_rank") + 0.5) / F.col("_inside") * STEPS
    pick = lambda step: F.element_at("_grid", (F.greatest(F.lit(0), F.least(F.lit(STEPS), step)) + 1).cast("int"))
    return open_.withColumns({"_low": pick(F.floor(share) - 1), "_high": pick(F.ceil(share) + 1)}).drop("_grid")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Both sides' columns by equal keys, null being equal to null."""
    named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


BRACKET = ["_from", "_to", "_low", "_high"]


def _met(rows: DataFrame, tight: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that lie in each old bracket and no higher than the new one, once for all ranks of a bracket.

    There are as many brackets as groups times ranks, so Spark sends them to every task or shuffles by
    their size; without keys there are as many as ranks.
    """
    brackets = tight.select(*keys, *BRACKET).distinct()
    met = _meet(rows, brackets, keys) if keys else rows.join(F.broadcast(brackets))
    return met.filter((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_high")))


def _sure(rank: Column, good: Column) -> Column:
    return F.when(good, rank).otherwise(F.raise_error(F.lit("a summary is further off than it may be")).cast("long"))


def _narrowed(rows: DataFrame, tight: DataFrame, keys: list[str]) -> DataFrame:
    """The brackets as those of the next pass, with the rank inside, the rows inside and their summary."""
    held = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))
    by = [*keys, *BRACKET]
    counted = _met(rows, tight, keys).groupBy(*by).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count(held).alias("_held"), F.min(held).alias("_least"), F.max(held).alias("_most"), _grid(held))
    named = _meet(tight, counted, by)
    rank = F.col("_rank") - F.col("_below")
    return named.select(*keys, "_name", _sure(rank, (rank >= 0) & (rank < F.col("_held"))).alias("_rank"), F.col("_held").alias("_inside"), F.col("_least").alias("_from"), F.col("_most").alias("_to"), "_grid")


def _counted(rows: DataFrame, tight: DataFrame, keys: list[str]) -> DataFrame:
    """The value of each rank from the occurrences of the bracket's values; all that lies below is one more."""
    by = [*keys, *BRACKET]
    values = _met(rows, tight, keys).groupBy(*by, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_times"))
    until = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
    running = values.withColumn("_until", F.sum("_times").over(until.rowsBetween(Window.unboundedPreceding, 0)))
    hit = (F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_times"))
    named = _meet(running, tight.select(*by, "_name", "_rank"), by).filter(hit)
    return named.select(*keys, "_name", F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.raise_error(F.lit("a summary is further off than it may be")).cast("double")).alias("_found"))
