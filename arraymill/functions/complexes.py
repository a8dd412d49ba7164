"""Complex numbers as ``STRUCT<re DOUBLE, im DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import INF, Value, col, copysign, divide, essentially_equal


def complex_(re: Value, im: Value = 0.0) -> Column:
    return F.struct(col(re).cast("double").alias("re"), col(im).cast("double").alias("im"))


def essentially_equal_complex(a: Column, b: Column, epsilon: float = 2.0**-52) -> Column:
    """Equality of both parts within a relative epsilon."""
    return essentially_equal(a["re"], b["re"], epsilon) & essentially_equal(a["im"], b["im"], epsilon)


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def polar(r: Value, theta: Value) -> Column:
    return complex_(col(r) * F.cos(col(theta)), col(r) * F.sin(col(theta)))


def proj(z: Column) -> Column:
    """Projection on the Riemann sphere: all infinities become one."""
    infinite = (F.abs(z["re"]) == INF) | (F.abs(z["im"]) == INF)
    return F.when(infinite, complex_(F.lit(INF), copysign(F.lit(0.0), z["im"]))).otherwise(z)


def add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def quotient(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_(divide(a["re"] * b["re"] + a["im"] * b["im"], size), divide(a["im"] * b["re"] - a["re"] * b["im"], size))


def exponential(z: Column) -> Column:
    return polar(F.exp(z["re"]), z["im"])


def less(a: Column, b: Column) -> Column:
    """Lexicographic order: real parts, then imaginary parts."""
    return (a["re"] < b["re"]) | ((a["re"] == b["re"]) & (a["im"] < b["im"]))
