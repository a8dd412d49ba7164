"""Aggregates over a value column, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _real(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def all_(v: Column) -> Column:
    return F.bool_and(v != 0)


def any_(v: Column) -> Column:
    return F.bool_or(v != 0)


def none(v: Column) -> Column:
    return ~F.bool_or(v != 0)


amax = max_ = F.max
amin = min_ = F.min
mean = F.avg
sum_ = F.sum
prod = F.product
var = F.var_pop
stdev = F.stddev_pop


def average(v: Column, weight: Column | None = None) -> Column:
    return F.avg(v) if weight is None else F.sum(v * weight) / F.sum(weight)


def contains(v: Column, wanted) -> Column:
    return F.bool_or(v == wanted)


def count_nonzero(v: Column) -> Column:
    return F.count_if(v != 0)


def size(v: Column) -> Column:
    return F.count(F.lit(1))


def ptp(v: Column) -> Column:
    return F.max(v) - F.min(v)


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def norm(v: Column) -> Column:
    return F.sqrt(F.sum(v * v))


def median(v: Column, integer: bool = False) -> Column:
    """The middle value; of integers, the two middles' mean is cut to an integer."""
    return F.floor(F.percentile(v, 0.5)).cast("long") if integer else F.percentile(v, 0.5)


def percentile(v: Column, p: float) -> Column:
    """p in percent, linear between neighbours. Other interpolations: operators.order.percentile."""
    return F.percentile(v, p / 100)


def nanmax(v: Column, compat: bool = False) -> Column:
    """Largest number; with compat, NaN counts as the least positive double."""
    return F.max(F.when(F.isnan(v), F.lit(2.2250738585072014e-308)).otherwise(v)) if compat else F.max(_real(v))


def nanmin(v: Column) -> Column:
    return F.min(_real(v))


def nansum(v: Column) -> Column:
    return F.coalesce(F.sum(_real(v)), F.lit(0.0))


def nanprod(v: Column) -> Column:
    return F.product(F.when(F.isnan(v), F.lit(1.0)).otherwise(v))


def nanmean(v: Column) -> Column:
    return F.avg(_real(v))


def nanvar(v: Column) -> Column:
    return F.var_pop(_real(v))


def nanstdev(v: Column) -> Column:
    return F.stddev_pop(_real(v))


def nanpercentile(v: Column, p: float) -> Column:
    return F.percentile(_real(v), p / 100)
