"""Element-wise mathematics as Column expressions, with IEEE results where SQL would fail or give null."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int
INF, NAN = float("inf"), float("nan")


def col(x: Value | str) -> Column:
    """A Column from a Column, a column name or a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def divide(a: Value, b: Value) -> Column:
    """Quotient of doubles: infinite or NaN for a zero divisor."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * INF)


def int_divide(a: Value, b: Value) -> Column:
    """Quotient of integers, truncated; null for a zero divisor."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.when(b != 0, F.floor(F.abs(a) / F.abs(b)).cast("long") * (F.signum(a.cast("double")) * F.signum(b.cast("double"))).cast("long"))


def _log(base: Callable[[Column], Column], shift: float = 0.0) -> Callable[[Value], Column]:
    def run(x: Value) -> Column:
        x = col(x).cast("double")
        return F.when(F.isnan(x) | (x < -shift), F.lit(NAN)).when(x == -shift, F.lit(-INF)).otherwise(base(x))

    return run


log, log10, log2, log1p = _log(F.ln), _log(F.log10), _log(F.log2), _log(F.log1p, 1.0)
exp, expm1, sqrt, cbrt = F.exp, F.expm1, F.sqrt, F.cbrt
sin, cos, tan, sinh, cosh, tanh = F.sin, F.cos, F.tan, F.sinh, F.cosh, F.tanh
arcsin, arccos, arctan, arcsinh, arccosh, arctanh = F.asin, F.acos, F.atan, F.asinh, F.acosh, F.atanh
deg2rad = radians = F.radians
rad2deg = degrees = F.degrees
rint = F.rint


def absolute(x: Value) -> Column:
    return F.abs(col(x))


def add(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def subtract(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def multiply(a: Value, b: Value) -> Column:
    return col(a) * col(b)


def negative(x: Value) -> Column:
    return -col(x)


def arctan2(y: Value, x: Value) -> Column:
    return F.atan2(col(y), col(x))


def round_even(x: Value, decimals: int = 0) -> Column:
    """Half-even rounding to decimals."""
    return F.rint(col(x) * 10.0**decimals) / 10.0**decimals


around = round_even


def astype(x: Value, bits: int, signed: bool = True) -> Column:
    """Integer of the given width with wrap-around in place of an overflow error."""
    span = 1 << bits
    whole = F.when(col(x) >= 0, F.floor(col(x))).otherwise(F.ceil(col(x))).cast("decimal(38,0)")
    low = F.pmod(whole, F.lit(span).cast("decimal(38,0)"))
    out = F.when(low >= F.lit(span // 2).cast("decimal(38,0)"), low - F.lit(span).cast("decimal(38,0)")).otherwise(low) if signed else low
    return out.cast("long") if bits < 64 or signed else out


def ceil(x: Value) -> Column:
    return F.ceil(col(x)).cast("double")


def floor(x: Value) -> Column:
    return F.floor(col(x)).cast("double")


def trunc(x: Value) -> Column:
    return F.when(col(x) >= 0, F.floor(col(x))).otherwise(F.ceil(col(x))).cast("double")


fix = trunc


def clip(x: Value, low: Value, high: Value) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def copysign(a: Value, b: Value) -> Column:
    return F.when(signbit(b), -F.abs(col(a))).otherwise(F.abs(col(a)))


def square(x: Value) -> Column:
    return col(x) * col(x)


def cube(x: Value) -> Column:
    return col(x) * col(x) * col(x)


def exp2(x: Value) -> Column:
    return F.pow(F.lit(2.0), col(x))


def floor_divide(a: Value, b: Value) -> Column:
    """Floor of the quotient of doubles; int_divide is the integer form."""
    return F.floor(divide(a, b)).cast("double")


def maximum(a: Value, b: Value) -> Column:
    return F.greatest(col(a), col(b))


def minimum(a: Value, b: Value) -> Column:
    return F.least(col(a), col(b))


fmax, fmin = maximum, minimum


def mod(a: Value, b: Value) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.when(col(b) != 0, col(a) % F.when(col(b) != 0, col(b)))


fmod = mod


def remainder(a: Value, b: Value) -> Column:
    """Remainder to the nearest multiple, halves to the even one."""
    return col(a) - col(b) * F.rint(divide(a, b))


def gcd(a: Value, b: Value) -> Column:
    """By arrays of 64-bit integers, a batch of rows at a time; null where either is null."""
    a, b = col(a).cast("long"), col(b).cast("long")

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return F.when(a.isNotNull() & b.isNotNull(), run(F.coalesce(a, F.lit(0).cast("long")), F.coalesce(b, F.lit(0).cast("long"))))


def lcm(a: Value, b: Value) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(int_divide(F.abs(col(a).cast("long")), g) * F.abs(col(b).cast("long")))


def half_up(x: Value, digits: int) -> Column:
    """Rounded to so many digits, halves upwards, as a double of any size: ``F.floor`` gives 64-bit integers, where larger values stop and NaN is 0."""
    scaled = col(x).cast("double") * 10.0**digits + 0.5
    # from 2^52 on all doubles are whole
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled) / 10.0**digits


def hypot(a: Value, b: Value, c: Value | None = None) -> Column:
    return F.hypot(col(a), col(b)) if c is None else F.sqrt(square(a) + square(b) + square(c))


def ldexp(x: Value, n: Value) -> Column:
    return col(x) * F.pow(F.lit(2.0), col(n))


def logaddexp(a: Value, b: Value) -> Column:
    return log(F.exp(col(a)) + F.exp(col(b)))


def logaddexp2(a: Value, b: Value) -> Column:
    return log2(exp2(a) + exp2(b))


def logb(x: Value, base: Value) -> Column:
    return divide(log(x), log(base))


def power(x: Value, n: int) -> Column:
    return F.pow(col(x), F.lit(float(n)))


def powerf(x: Value, y: Value) -> Column:
    return F.pow(col(x), col(y))


def nth_root(x: Value, n: Value) -> Column:
    return F.pow(col(x), divide(1.0, n))


def reciprocal(x: Value) -> Column:
    return divide(1.0, x)


def sign(x: Value) -> Column:
    return F.signum(col(x)).cast("int")


def signbit(x: Value) -> Column:
    """Whether the value is below zero (no matter the sign of a zero or NaN)."""
    return col(x) < 0


def sinc(x: Value) -> Column:
    """sin(pi x) / (pi x), which is NaN at 0."""
    return divide(F.sin(col(x) * math.pi), col(x) * math.pi)


def unwrap(x: Value) -> Column:
    """Each angle by itself in [-pi, pi]."""
    return F.atan2(F.sin(col(x)), F.cos(col(x)))


def interp(a: Value, b: Value, share: Value) -> Column:
    return col(a) * (1 - col(share)) + col(b) * col(share)


def gaussian1d(x: Value, mu: Value, sigma: float) -> Column:
    return F.exp(-square(col(x) - col(mu)) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))


def gaussian(x: Value, y: Value, sigma: float) -> Column:
    return F.exp(-(square(x) + square(y)) / (2 * sigma**2)) / (2 * math.pi * sigma**2)


def to_text(x: Value) -> Column:
    return col(x).cast("string")


def dtype_info(kind: str) -> dict[str, float | int | bool]:
    """Bits, sign, wholeness, epsilon and range of an element type, by Spark's or the array's name for it."""
    named = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
    own = np.dtype(named.get(kind, kind))
    whole = own.kind in "iu"
    limits = np.iinfo(own) if whole else np.finfo(own)
    return {"bits": own.itemsize * 8, "is_integer": whole, "is_signed": own.kind != "u", "epsilon": 0.0 if whole else float(limits.eps), "min": int(limits.min) if whole else float(limits.min), "max": int(limits.max) if whole else float(limits.max)}


def epsilon_of(kind: str) -> float:
    return {"float": 2.0**-23, "double": 2.0**-52}.get(kind, 0.0)


def essentially_equal(a: Value, b: Value, epsilon: float = 2.0**-52) -> Column:
    """Equality within a relative epsilon; NaN equals nothing."""
    a, b = col(a), col(b)
    return F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(False)).otherwise((a == b) | (F.abs(a - b) <= F.least(F.abs(a), F.abs(b)) * epsilon))


def nan_to_num(x: Value, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = col(x)
    return F.when(F.isnan(x), F.lit(nan)).when(x == INF, F.lit(posinf)).when(x == -INF, F.lit(neginf)).otherwise(x)
