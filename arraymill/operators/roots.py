"""Roots of scalar functions, one for each row's bracket or start, vectorised over Arrow batches.

f works on numpy arrays. All methods run until |f| is below epsilon in every row and raise after
``most`` rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[np.ndarray], np.ndarray]


def _until(step: Callable, state: tuple, f: Fn, epsilon: float, most: int) -> np.ndarray:
    for _ in range(most):
        done = np.abs(f(state[0])) < epsilon
        if done.all():
            return state[0]
        new = step(*state)
        state = tuple(np.where(done, a, b) for a, b in zip(state, new, strict=True))
    raise RuntimeError("the root wasn't reached within the most rounds")


def bisection(f: Fn, a: np.ndarray, b: np.ndarray, epsilon: float = 1e-12, most: int = 1000) -> np.ndarray:
    a, b = np.array(a, float), np.array(b, float)

    def step(x, low, high):
        left = f(low) * f(x) <= 0
        low, high = np.where(left, low, x), np.where(left, x, high)
        return (low + high) / 2, low, high

    return _until(step, ((a + b) / 2, a, b), f, epsilon, most)


def secant(f: Fn, a: np.ndarray, b: np.ndarray, epsilon: float = 1e-12, most: int = 1000) -> np.ndarray:
    def step(x, last):
        rise = f(x) - f(last)
        return x - f(x) * (x - last) / np.where(rise == 0, 1e-300, rise), x

    return _until(step, (np.array(b, float), np.array(a, float)), f, epsilon, most)


def newton(f: Fn, slope: Fn, start: np.ndarray, epsilon: float = 1e-12, most: int = 1000) -> np.ndarray:
    return _until(lambda x: (x - f(x) / slope(x),), (np.array(start, float),), f, epsilon, most)


def dekker(f: Fn, a: np.ndarray, b: np.ndarray, epsilon: float = 1e-12, most: int = 1000) -> np.ndarray:
    """Secant steps that stay between the best point and the middle of the bracket, else the middle."""

    def step(x, other, last):
        rise = f(x) - f(last)
        s = x - f(x) * (x - last) / np.where(rise == 0, np.nan, rise)
        m = (x + other) / 2
        inside = (s > np.minimum(x, m)) & (s < np.maximum(x, m))
        new = np.where(inside, s, m)
        kept = np.where(f(new) * f(other) <= 0, other, x)
        swap = np.abs(f(kept)) < np.abs(f(new))
        return np.where(swap, kept, new), np.where(swap, new, kept), x

    return _until(step, _ordered(f, a, b), f, epsilon, most)


def brent(f: Fn, a: np.ndarray, b: np.ndarray, epsilon: float = 1e-12, most: int = 1000) -> np.ndarray:
    """Inverse quadratic interpolation where three values differ, else secants, else bisection."""

    def step(x, other, last):
        fx, fo, fl = f(x), f(other), f(last)
        with np.errstate(all="ignore"):
            quadratic = x * fo * fl / ((fx - fo) * (fx - fl)) + other * fx * fl / ((fo - fx) * (fo - fl)) + last * fx * fo / ((fl - fx) * (fl - fo))
            line = x - fx * (x - other) / (fx - fo)
        s = np.where((fx != fl) & (fo != fl), quadratic, line)
        m = (x + other) / 2
        edge = (3 * x + other) / 4
        good = np.isfinite(s) & (s > np.minimum(edge, x)) & (s < np.maximum(edge, x)) & (np.abs(s - x) < np.abs(other - x) / 2)
        new = np.where(good, s, m)
        kept = np.where(f(new) * fo <= 0, other, x)
        swap = np.abs(f(kept)) < np.abs(f(new))
        return np.where(swap, kept, new), np.where(swap, new, kept), x

    return _until(step, _ordered(f, a, b), f, epsilon, most)


def _ordered(f: Fn, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The better end first, and the worse one twice."""
    a, b = np.array(a, float), np.array(b, float)
    swap = np.abs(f(a)) < np.abs(f(b))
    return np.where(swap, a, b), np.where(swap, b, a), np.where(swap, b, a)


def column(solve: Callable[..., np.ndarray], *args: Column) -> Column:
    """A solver such as ``lambda a, b: brent(f, a, b)`` over columns."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(solve(*[s.to_numpy(float) for s in series]))

    return run(*args)
