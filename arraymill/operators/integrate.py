"""Numerical integration of a Column function over an interval, its points a distributed range."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _sum(spark: SparkSession, n: int, value: Fn) -> float:
    return float(spark.range(n).agg(F.sum(value(F.col("id").cast("double")))).first()[0] or 0.0)


def trapezoidal(spark: SparkSession, low: float, high: float, n: int, f: Fn) -> float:
    h = (high - low) / n
    return _sum(spark, n, lambda i: (f(low + i * h) + f(low + (i + 1) * h)) * (h / 2))


def simpson(spark: SparkSession, low: float, high: float, n: int, f: Fn) -> float:
    h = (high - low) / n
    return _sum(spark, n, lambda i: (f(low + i * h) + 4 * f(low + (i + 0.5) * h) + f(low + (i + 1) * h)) * (h / 6))


def romberg(spark: SparkSession, low: float, high: float, n: int, f: Fn) -> float:
    """Richardson's scheme over n halvings of the trapezoidal rule; new points only in each round."""
    h = high - low
    rows = [[trapezoidal(spark, low, high, 1, f)]]
    for k in range(1, n):
        h /= 2
        own = [rows[-1][0] / 2 + h * _sum(spark, 1 << (k - 1), lambda i, h=h: f(low + (2 * i + 1) * h))]
        for m in range(1, k + 1):
            own.append(own[-1] + (own[-1] - rows[-1][m - 1]) / (4**m - 1))
        rows.append(own)
    return rows[-1][-1]


def gauss_legendre(spark: SparkSession, low: float, high: float, n: int, f: Fn) -> float:
    """Weights and nodes are a table of n rows."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    rows = spark.createDataFrame([(float(x), float(w)) for x, w in zip(nodes, weights, strict=True)], "x double, w double")
    half = (high - low) / 2
    return float(rows.agg(F.sum(F.col("w") * f(low + half * (F.col("x") + 1)))).first()[0]) * half


def _over_steps(n: int, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda total, i: total + term(i.cast("double")))


def trapezoidal_of(low: Column, high: Column, n: int, f: Fn) -> Column:
    """The integral between two columns of each row, by n steps."""
    h = (high - low) / n
    return _over_steps(n, lambda i: (f(low + i * h) + f(low + (i + 1) * h)) * (h / 2))


def simpson_of(low: Column, high: Column, n: int, f: Fn) -> Column:
    h = (high - low) / n
    return _over_steps(n, lambda i: (f(low + i * h) + 4 * f(low + (i + 0.5) * h) + f(low + (i + 1) * h)) * (h / 6))


def romberg_of(low: Column, high: Column, n: int, f: Fn) -> Column:
    """Richardson's scheme as one sum: the trapezoidal rules of 1, 2, 4, ... steps with fixed weights."""
    weights = [np.eye(n)[k] for k in range(n)]
    for m in range(1, n):
        weights = [w + (w - before) / (4**m - 1) for before, w in zip(weights, weights[1:], strict=False)]
    rules = [float(w) * trapezoidal_of(low, high, 1 << k, f) for k, w in enumerate(weights[0])]
    return sum(rules[1:], rules[0])


def gauss_legendre_of(low: Column, high: Column, n: int, f: Fn) -> Column:
    nodes, weights = np.polynomial.legendre.leggauss(n)
    half = (high - low) / 2
    terms = [float(w) * f(low + half * (float(x) + 1)) for x, w in zip(nodes, weights, strict=True)]
    return half * sum(terms[1:], terms[0])


def column(rule: Callable[..., np.ndarray], low: Column, high: Column, n: int, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A rule's integral of an array function between two columns of each row, a batch of rows at a time."""

    @F.pandas_udf("double")
    def run(low: pd.Series, high: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(rule(low.to_numpy(float), high.to_numpy(float), n, f))

    return run(low.cast("double"), high.cast("double"))


# rules over arrays: steps are a loop and rows the arrays, so a batch needs a few numbers a row


def trapezoidal_rows(low: np.ndarray, high: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    h = (high - low) / n
    total = (f(low) + f(high)) / 2
    for i in range(1, n):
        total = total + f(low + i * h)
    return total * h


def simpson_rows(low: np.ndarray, high: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    h = (high - low) / n
    total = f(low) + f(high)
    for i in range(n):
        total = total + 4 * f(low + (i + 0.5) * h) + (2 * f(low + i * h) if i else 0.0)
    return total * (h / 6)


def romberg_rows(low: np.ndarray, high: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Richardson's scheme over n halvings; new points only in each round."""
    h = high - low
    last = [(f(low) + f(high)) / 2 * h]
    for k in range(1, n):
        h = h / 2
        own = [last[0] / 2 + h * sum(f(low + (2 * i + 1) * h) for i in range(1 << (k - 1)))]
        for m in range(1, k + 1):
            own.append(own[-1] + (own[-1] - last[m - 1]) / (4**m - 1))
        last = own
    return last[-1]


def gauss_legendre_rows(low: np.ndarray, high: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    half = (high - low) / 2
    return half * sum(w * f(low + half * (x + 1)) for x, w in zip(*np.polynomial.legendre.leggauss(n), strict=True))
