"""Polynomials: coefficients in rising order, and the classical families by recurrence as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import Value, col


@dataclass(frozen=True)
class Poly1d:
    coefficients: tuple[float, ...]

    @staticmethod
    def from_roots(roots: list[float]) -> Poly1d:
        return Poly1d(tuple(np.polynomial.polynomial.polyfromroots(roots).tolist()))

    @staticmethod
    def fit(rows: DataFrame, x: Column, y: Column, order: int, weight: Column | None = None) -> Poly1d:
        """Least squares from power sums, one aggregation whatever the number of rows."""
        w = F.lit(1.0) if weight is None else weight
        powers = [F.sum(w * F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * order + 1)]
        sums = rows.agg(*powers, *[F.sum(w * y * F.pow(x, F.lit(float(k)))).alias(f"t{k}") for k in range(order + 1)]).first()
        m = np.array([[sums[f"s{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
        return Poly1d(tuple(np.linalg.solve(m, np.array([sums[f"t{k}"] for k in range(order + 1)])).tolist()))

    @property
    def order(self) -> int:
        return len(self.coefficients) - 1

    def __call__(self, x: Value) -> Column:
        """Horner's scheme."""
        out = F.lit(0.0)
        for c in reversed(self.coefficients):
            out = out * col(x) + float(c)
        return out

    def deriv(self) -> Poly1d:
        return Poly1d(tuple(k * c for k, c in enumerate(self.coefficients))[1:] or (0.0,))

    def integ(self, constant: float = 0.0) -> Poly1d:
        return Poly1d((constant, *(c / (k + 1) for k, c in enumerate(self.coefficients))))

    def area(self, a: float, b: float) -> float:
        own = np.polynomial.polynomial.Polynomial(self.integ().coefficients)
        return float(own(b) - own(a))

    def __add__(self, other: Poly1d) -> Poly1d:
        return Poly1d(tuple(np.polynomial.polynomial.polyadd(self.coefficients, other.coefficients).tolist()))

    def __sub__(self, other: Poly1d) -> Poly1d:
        return Poly1d(tuple(np.polynomial.polynomial.polysub(self.coefficients, other.coefficients).tolist()))

    def __mul__(self, other: Poly1d) -> Poly1d:
        return Poly1d(tuple(np.polynomial.polynomial.polymul(self.coefficients, other.coefficients).tolist()))

    def __pow__(self, n: int) -> Poly1d:
        return Poly1d(tuple(np.polynomial.polynomial.polypow(self.coefficients, n).tolist()))

    def __str__(self) -> str:
        return " + ".join(f"{c:g}" + (f"x^{k}" if k > 1 else "x" * k) for k, c in enumerate(self.coefficients))


def _recurrence(n: int, first: Column, second: Column, step) -> Column:
    """Values 0 and 1 of a family, carried on to n inside one array fold so that plans stay small."""
    if n == 0:
        return first
    start = F.struct(first.alias("a"), second.alias("b"))
    if n == 1:
        return second
    fold = lambda s, k: F.struct(s["b"].alias("a"), step(k, s["a"], s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, fold, lambda s: s["b"])


def chebyshev_t(n: int, x: Value) -> Column:
    x = col(x).cast("double")
    return _recurrence(n, F.lit(1.0), x, lambda k, a, b: 2 * x * b - a)


def chebyshev_u(n: int, x: Value) -> Column:
    x = col(x).cast("double")
    return _recurrence(n, F.lit(1.0), 2 * x, lambda k, a, b: 2 * x * b - a)


def hermite(n: int, x: Value) -> Column:
    x = col(x).cast("double")
    return _recurrence(n, F.lit(1.0), 2 * x, lambda k, a, b: 2 * x * b - 2 * k * a)


def laguerre(n: int, x: Value, m: int = 0) -> Column:
    """Laguerre polynomial; associated for m above 0."""
    x = col(x).cast("double")
    return _recurrence(n, F.lit(1.0), 1 + m - x, lambda k, a, b: ((2 * k + 1 + m - x) * b - (k + m) * a) / (k + 1))


def legendre_p(n: int, x: Value, m: int = 0) -> Column:
    """Legendre function of the first kind; associated, with the Condon-Shortley sign, for m above 0."""
    x = col(x).cast("double")
    if m > n:
        return F.lit(0.0)
    odd = math.prod(range(1, 2 * m, 2))
    base = (-1) ** m * odd * F.pow(1 - x * x, F.lit(m / 2))
    first, second = base, x * (2 * m + 1) * base
    return _recurrence(n - m, first, second, lambda k, a, b: ((2 * (k + m) + 1) * x * b - (k + 2 * m) * a) / (k + 1))


def legendre_q(n: int, x: Value) -> Column:
    x = col(x).cast("double")
    q0 = F.log((1 + x) / (1 - x)) / 2
    return _recurrence(n, q0, x * q0 - 1, lambda k, a, b: ((2 * k + 1) * x * b - k * a) / (k + 1))


def spherical_harmonic(n: int, m: int, theta: Value, phi: Value) -> Column:
    """Y of degree n and order m (not negative) at polar angle theta and azimuth phi, as ``STRUCT<re, im>``."""
    size = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - m) / math.factorial(n + m))
    r = size * legendre_p(n, F.cos(col(theta)), m)
    return F.struct((r * F.cos(m * col(phi))).alias("re"), (r * F.sin(m * col(phi))).alias("im"))
