"""Special functions over arrays, and as Columns through Arrow-batched functions.

``column(f)`` turns any of the array functions into one over Columns, which works out each distinct
argument of a batch once. Integral representations are summed with Gauss-Legendre or tanh-sinh-like substitutions on fixed nodes, recurrences and
asymptotic series elsewhere; all are vectorised, element by element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import Value, col

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(400)
#: Arguments that a function gets at once; its integrals hold some arrays of a value for each argument and node.
BLOCK = 128


def _distinct(values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the arrays, told apart by their bits, and the place of each row among them."""
    first = back = np.zeros(len(values[0]), np.int64)
    for v in values:
        _, at = np.unique(np.ascontiguousarray(v).view(np.int64), return_inverse=True)
        _, first, back = np.unique(back * (at.max(initial=0) + 1) + at, return_index=True, return_inverse=True)
    return [v[first] for v in values], back


def each_distinct(f: Callable[..., np.ndarray], *values: np.ndarray) -> np.ndarray:
    """f of each row, where f works element by element: once for rows that are alike, in blocks of ``BLOCK``."""
    own, back = _distinct([np.asarray(v, float) for v in values])
    blocks = [np.asarray(f(*[v[i : i + BLOCK] for v in own]), float) for i in range(0, len(own[0]), BLOCK)]
    return np.concatenate(blocks)[back] if blocks else np.zeros(0)


def column(f: Callable[..., np.ndarray], *args: Value) -> Column:
    """f over Columns, in double precision; f works element by element."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(each_distinct(f, *[s.to_numpy(float) for s in series]))

    return run(*[col(a).cast("double") for a in args])


def _integral(f: Callable[[np.ndarray], np.ndarray], low: float, high) -> np.ndarray:
    """Integral of f over low to high (a number or a value for each element) along a new last axis."""
    high = np.asarray(high, float)
    half = (high - low) / 2
    at = low + half[..., None] * (_NODES + 1)
    return (f(at) * _WEIGHTS).sum(-1) * half


def _each(f: Callable[[float], float]) -> Callable[[np.ndarray], np.ndarray]:
    def run(x):
        out = []
        for v in np.atleast_1d(np.asarray(x, float)).ravel():
            try:
                out.append(f(v))
            except (ValueError, ZeroDivisionError):
                out.append(math.nan)
            except OverflowError:
                out.append(math.inf)
        return np.array(out).reshape(np.shape(np.atleast_1d(x)))

    return run


erf, erfc, gamma, log_gamma = _each(math.erf), _each(math.erfc), _each(math.gamma), _each(math.lgamma)


def gamma1pm1(x):
    """gamma(x + 1) - 1, without cancellation near 0."""
    x = np.asarray(x, float)
    return np.where(np.abs(x) < 0.5, np.expm1(log_gamma(1 + x)), gamma(1 + x) - 1)


def beta(a, b):
    return np.exp(log_gamma(a) + log_gamma(b) - log_gamma(np.asarray(a) + b))


def erf_inv(y):
    """Newton's method from a rough logarithmic estimate."""
    y = np.asarray(y, float)
    inner = np.clip(y, -1 + 1e-16, 1 - 1e-16)
    w = np.log1p(-inner * inner)
    t = 2 / (math.pi * 0.147) + w / 2
    x = np.sign(inner) * np.sqrt(np.maximum(np.sqrt(t * t - w / 0.147) - t, 0))
    for _ in range(4):
        # the tail is the better conditioned side of the equation
        off = np.where(inner >= 0, (1 - inner) - erfc(x), erfc(-x) - (1 + inner))
        x = x - off / (2 / math.sqrt(math.pi) * np.exp(-x * x))
    return np.where(np.abs(y) > 1, np.nan, np.where(np.abs(y) == 1, np.sign(y) * np.inf, x))


def erfc_inv(y):
    return erf_inv(1 - np.asarray(y, float))


def _shifted(x, least: float, term: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x raised by whole steps to at least ``least``, and the terms of the steps added up."""
    x, total = np.array(x, float), np.zeros(np.shape(x))
    while (x < least).any():
        low = x < least
        total = np.where(low, total + term(x), total)
        x = np.where(low, x + 1, x)
    return x, total


#: Bernoulli numbers of index 2, 4, ... by their recurrence.
def _bernoulli(count: int) -> list[float]:
    from fractions import Fraction

    b = [Fraction(1)]
    for m in range(1, 2 * count + 1):
        b.append(-sum(math.comb(m + 1, k) * b[k] for k in range(m)) / (m + 1))
    return [float(b[2 * k]) for k in range(1, count + 1)]


_B = _bernoulli(12)


def bernoulli(n):
    """The Bernoulli number of index 2n; beyond double precision it is infinite."""
    k = np.trunc(np.atleast_1d(np.asarray(n, float)))
    size = _each(lambda v: math.exp(math.lgamma(2 * v + 1) - 2 * v * math.log(2 * math.pi)))(k)
    return np.where(k == 0, 1.0, np.where(k % 2 == 0, -2, 2) * size * riemann_zeta(2 * k))


def polygamma(n: int, x):
    """The n-th derivative of the digamma function, for positive x."""
    if n == 0:
        return digamma(x)
    sign, fact = (-1) ** (n + 1), math.factorial(n)
    x, near = _shifted(x, 20.0, lambda v: 1 / v ** (n + 1))
    tail = math.factorial(n - 1) / x**n + fact / (2 * x ** (n + 1))
    for k, b in enumerate(_B, 1):
        tail = tail + b * math.exp(math.lgamma(2 * k + n) - math.lgamma(2 * k + 1)) / x ** (2 * k + n)
    return sign * (fact * near + tail)


def digamma(x):
    x = np.atleast_1d(np.asarray(x, float))
    mirrored = x <= 0
    y, near = _shifted(np.where(mirrored, 1 - x, x), 20.0, lambda v: 1 / v)
    out = np.log(y) - 1 / (2 * y) - sum(b / (2 * k * y ** (2 * k)) for k, b in enumerate(_B, 1)) - near
    return np.where(mirrored, out - math.pi / np.tan(math.pi * x), out)


def trigamma(x):
    return polygamma(1, x)


def riemann_zeta(s):
    """Euler-Maclaurin summation, with the functional equation below 0."""
    s = np.atleast_1d(np.asarray(s, float))
    low = s < 0
    t = np.where(low, 1 - s, s)
    n = 25
    total = sum(k**-t for k in range(1, n)) + n ** (1 - t) / (t - 1) + 0.5 * n**-t
    rising, power = t, n ** (-t - 1)
    for k, b in enumerate(_B, 1):
        total = total + b / math.factorial(2 * k) * rising * power
        rising = rising * (t + 2 * k - 1) * (t + 2 * k)
        power = power / n**2
    if low.any():
        other = 2**s * math.pi ** (s - 1) * np.sin(math.pi * s / 2) * gamma(1 - s) * total
        return np.where(low, other, total)
    return total


def expint(x):
    """The exponential integral Ei."""
    x = np.atleast_1d(np.asarray(x, float))
    series = np.euler_gamma + np.log(np.abs(x))
    term = np.ones_like(x)
    for k in range(1, 200):
        term = term * np.clip(x, -40, 40) / k
        series = series + term / k
    large = np.exp(x) / x * sum(math.factorial(k) / x**k for k in range(20))
    # for clearly negative x the continued fraction of E1
    t, frac = np.maximum(-x, 1e-300), np.zeros_like(x)
    for k in range(200, 0, -1):
        frac = k / (1 + k / (t + frac))
    return np.where(x > 40, large, np.where(x < -2, -np.exp(-t) / (t + frac), series))


def bessel_jn(v, x):
    v, x = np.broadcast_arrays(np.asarray(v, float), np.asarray(x, float))
    a = _integral(lambda t: np.cos(v[..., None] * t - x[..., None] * np.sin(t)), 0, np.full(x.shape, math.pi)) / math.pi
    return a - np.sin(v * math.pi) / math.pi * _integral(lambda t: np.exp(-x[..., None] * np.sinh(t) - v[..., None] * t), 0, _far(x))


def bessel_yn(v, x):
    v, x = np.broadcast_arrays(np.asarray(v, float), np.asarray(x, float))
    a = _integral(lambda t: np.sin(x[..., None] * np.sin(t) - v[..., None] * t), 0, np.full(x.shape, math.pi)) / math.pi
    both = lambda t: (np.exp(v[..., None] * t) + np.exp(-v[..., None] * t) * np.cos(v[..., None] * math.pi)) * np.exp(-x[..., None] * np.sinh(t))
    return a - _integral(both, 0, _far(x, v)) / math.pi


def bessel_in(v, x):
    v, x = np.broadcast_arrays(np.asarray(v, float), np.asarray(x, float))
    a = _integral(lambda t: np.exp(x[..., None] * np.cos(t)) * np.cos(v[..., None] * t), 0, np.full(x.shape, math.pi)) / math.pi
    return a - np.sin(v * math.pi) / math.pi * _integral(lambda t: np.exp(-x[..., None] * np.cosh(t) - v[..., None] * t), 0, _far(x))


def bessel_kn(v, x):
    v, x = np.broadcast_arrays(np.asarray(v, float), np.asarray(x, float))
    return _integral(lambda t: np.exp(-x[..., None] * np.cosh(t)) * np.cosh(v[..., None] * t), 0, _far(x, v))


def _far(x, v=0.0) -> np.ndarray:
    """Where exp(-x sinh t + v t) is below double precision."""
    t = np.full(np.shape(x), 1.0)
    for _ in range(40):
        t = np.arcsinh((745 + np.abs(v) * t) / np.maximum(np.abs(x), 1e-8))
    return np.maximum(t, 1.0)


def bessel_jn_prime(v, x):
    return (bessel_jn(np.asarray(v) - 1, x) - bessel_jn(np.asarray(v) + 1, x)) / 2


def bessel_yn_prime(v, x):
    return (bessel_yn(np.asarray(v) - 1, x) - bessel_yn(np.asarray(v) + 1, x)) / 2


def bessel_in_prime(v, x):
    return (bessel_in(np.asarray(v) - 1, x) + bessel_in(np.asarray(v) + 1, x)) / 2


def bessel_kn_prime(v, x):
    return -(bessel_kn(np.asarray(v) - 1, x) + bessel_kn(np.asarray(v) + 1, x)) / 2


def spherical_bessel_jn(n, x):
    return np.sqrt(math.pi / (2 * np.asarray(x, float))) * bessel_jn(np.asarray(n) + 0.5, x)


def spherical_bessel_yn(n, x):
    return np.sqrt(math.pi / (2 * np.asarray(x, float))) * bessel_yn(np.asarray(n) + 0.5, x)


def _airy(x, rising: Callable, falling: Callable, zero: float):
    """By the functions of either side of 0, each for its own arguments only."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.full(x.shape, zero)
    away = ~(np.abs(x) < 1e-12)
    for side, f in ((away & (x > 0), rising), (away & ~(x > 0), falling)):
        if side.any():
            a = np.abs(x[side])
            out[side] = f(a, 2 / 3 * a**1.5)
    return out


def airy_ai(x):
    return _airy(x, lambda a, z: np.sqrt(a / 3) / math.pi * bessel_kn(1 / 3, z), lambda a, z: np.sqrt(a) / 3 * (bessel_jn(1 / 3, z) + bessel_jn(-1 / 3, z)), 1 / (3 ** (2 / 3) * math.gamma(2 / 3)))


def airy_bi(x):
    return _airy(x, lambda a, z: np.sqrt(a / 3) * (bessel_in(-1 / 3, z) + bessel_in(1 / 3, z)), lambda a, z: np.sqrt(a / 3) * (bessel_jn(-1 / 3, z) - bessel_jn(1 / 3, z)), 1 / (3 ** (1 / 6) * math.gamma(2 / 3)))


def airy_ai_prime(x):
    return _airy(x, lambda a, z: -a / (math.pi * math.sqrt(3)) * bessel_kn(2 / 3, z), lambda a, z: a / 3 * (bessel_jn(2 / 3, z) - bessel_jn(-2 / 3, z)), -1 / (3 ** (1 / 3) * math.gamma(1 / 3)))


def airy_bi_prime(x):
    return _airy(x, lambda a, z: a / math.sqrt(3) * (bessel_in(-2 / 3, z) + bessel_in(2 / 3, z)), lambda a, z: a / math.sqrt(3) * (bessel_jn(-2 / 3, z) + bessel_jn(2 / 3, z)), 3 ** (1 / 6) / math.gamma(1 / 3))


def ellint_1(k, phi):
    """Incomplete elliptic integral of the first kind, modulus k."""
    k = np.asarray(k, float)[..., None]
    return _integral(lambda t: 1 / np.sqrt(1 - (k * np.sin(t)) ** 2), 0, phi)


def ellint_2(k, phi):
    k = np.asarray(k, float)[..., None]
    return _integral(lambda t: np.sqrt(1 - (k * np.sin(t)) ** 2), 0, phi)


def ellint_3(k, v, phi):
    k, v = (np.asarray(a, float)[..., None] for a in (k, v))
    return _integral(lambda t: 1 / ((1 - v * np.sin(t) ** 2) * np.sqrt(1 - (k * np.sin(t)) ** 2)), 0, phi)


def comp_ellint_1(k):
    """Complete integral by the arithmetic-geometric mean."""
    a, b = np.ones_like(np.asarray(k, float)), np.sqrt(1 - np.asarray(k, float) ** 2)
    for _ in range(40):
        a, b = (a + b) / 2, np.sqrt(a * b)
    return math.pi / (2 * a)


def comp_ellint_2(k):
    return ellint_2(k, np.full(np.shape(k), math.pi / 2))


def comp_ellint_3(k, v):
    return ellint_3(k, v, np.full(np.shape(k), math.pi / 2))


def hankel(v: Value, x: Value, kind: int = 1, spherical: bool = False) -> Column:
    """Hankel function of the first or second kind as ``STRUCT<re, im>``."""
    j, y = (spherical_bessel_jn, spherical_bessel_yn) if spherical else (bessel_jn, bessel_yn)
    im = column(y, v, x)
    return F.struct(column(j, v, x).alias("re"), (im if kind == 1 else -im).alias("im"))


def factorial(n: Value) -> Column:
    """n! in double precision."""
    return F.aggregate(F.when(col(n) >= 1, F.sequence(F.lit(1), col(n).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda s, k: s * k)


def pnr(n: Value, r: Value) -> Column:
    """Permutations of r out of n."""
    low = (col(n) - col(r) + 1).cast("int")
    return F.when(col(r) > col(n), 0.0).when(col(r) == 0, 1.0).otherwise(F.aggregate(F.sequence(low, col(n).cast("int")), F.lit(1.0), lambda s, k: s * k))


def cnr(n: Value, r: Value) -> Column:
    """Combinations of r out of n."""
    return F.rint(pnr(n, r) / factorial(r))


def prime(n: int) -> int:
    """The n-th prime, 2 being number 0."""
    most = max(15, int((n + 1) * (math.log(n + 2) + math.log(math.log(n + 3)) + 1)))
    sieve = np.ones(most + 1, bool)
    sieve[:2] = False
    for p in range(2, int(most**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return int(np.flatnonzero(sieve)[n])


def primes(n: Value, most: int = 10_000) -> Column:
    """The n-th prime of a column of indexes below ``most``, from a table worked out once a batch."""
    return column(lambda x: np.array([prime(int(v)) if 0 <= v < most else math.nan for v in x], float), n)
