"""Comparison, predicates and conditional selection as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import INF, Value, col, essentially_equal


def equal(a: Value, b: Value) -> Column:
    return essentially_equal(a, b)


def not_equal(a: Value, b: Value) -> Column:
    return ~essentially_equal(a, b)


def less(a: Value, b: Value) -> Column:
    return col(a) < col(b)


def less_equal(a: Value, b: Value) -> Column:
    return col(a) <= col(b)


def greater(a: Value, b: Value) -> Column:
    return col(a) > col(b)


def greater_equal(a: Value, b: Value) -> Column:
    return col(a) >= col(b)


def isclose(a: Value, b: Value, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = col(a), col(b)
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b)))


def isnan(x: Value) -> Column:
    return F.isnan(col(x))


def isposinf(x: Value) -> Column:
    return col(x) == INF


def isneginf(x: Value) -> Column:
    return col(x) == -INF


def isinf(x: Value) -> Column:
    return F.abs(col(x)) == INF


def logical_and(a: Value, b: Value) -> Column:
    return (col(a) != 0) & (col(b) != 0)


def logical_or(a: Value, b: Value) -> Column:
    return (col(a) != 0) | (col(b) != 0)


def logical_xor(a: Value, b: Value) -> Column:
    return (col(a) != 0) != (col(b) != 0)


def logical_not(x: Value) -> Column:
    return col(x) == 0


def where(mask: Column, a: Value, b: Value) -> Column:
    return F.when(mask, col(a)).otherwise(col(b))


def select(conditions: list[Column], choices: list[Value], default: Value = 0) -> Column:
    """The choice of the first condition that holds, else the default."""
    out = col(default)
    for condition, choice in zip(reversed(conditions), reversed(choices), strict=True):
        out = F.when(condition, col(choice)).otherwise(out)
    return out
