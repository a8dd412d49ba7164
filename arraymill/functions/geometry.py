"""Vectors, rotations and celestial coordinates: arrays of Columns in, Columns out."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import Value, col, divide

Vector = list[Column]


def vector(*parts: Value) -> Vector:
    return [col(p).cast("double") for p in parts]


#: Unit directions: x to the right, y up, z forward.
DIRECTIONS = {"right": (1, 0, 0), "left": (-1, 0, 0), "up": (0, 1, 0), "down": (0, -1, 0), "forward": (0, 0, 1), "back": (0, 0, -1)}


def direction(name: str, dims: int = 3) -> Vector:
    return vector(*map(float, DIRECTIONS[name][:dims]))


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(subtract(a, b))


def add(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def subtract(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vector, by: Value) -> Vector:
    return [x * col(by) for x in a]


def normalize(a: Vector) -> Vector:
    n = norm(a)
    return [divide(x, n) for x in a]


def angle(a: Vector, b: Vector) -> Column:
    """Angle between vectors, 0 to pi."""
    return F.acos(F.greatest(F.least(divide(dot(a, b), norm(a) * norm(b)), F.lit(1.0)), F.lit(-1.0)))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def project(a: Vector, onto: Vector) -> Vector:
    return scale(onto, divide(dot(a, onto), dot(onto, onto)))


def lerp(a: Vector, b: Vector, share: Value) -> Vector:
    t = F.greatest(F.least(col(share), F.lit(1.0)), F.lit(0.0))
    return [x + (y - x) * t for x, y in zip(a, b, strict=True)]


def clamp_magnitude(a: Vector, most: float) -> Vector:
    n = norm(a)
    return [F.when(n > most, divide(x, n) * most).otherwise(x) for x in a]


def rodrigues(axis: Vector, theta: Value, v: Vector) -> Vector:
    """v turned about an axis by theta."""
    k, c, s = normalize(axis), F.cos(col(theta)), F.sin(col(theta))
    kv, kd = cross(k, v), dot(k, v)
    return [v[i] * c + kv[i] * s + k[i] * kd * (1 - c) for i in range(3)]


# ---- quaternions as [i, j, k, s]


def quaternion(i: Value, j: Value, k: Value, s: Value) -> Vector:
    """A unit quaternion."""
    return normalize(vector(i, j, k, s))


def axis_angle_quaternion(axis: Vector, theta: Value) -> Vector:
    half = col(theta) / 2
    return [*[x * F.sin(half) for x in normalize(axis)], F.cos(half)]


def euler_quaternion(roll: Value, pitch: Value, yaw: Value) -> Vector:
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(col(a) / 2), F.sin(col(a) / 2)) for a in (roll, pitch, yaw))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def quaternion_multiply(p: Vector, q: Vector) -> Vector:
    a, b = p[:3], q[:3]
    c = cross(a, b)
    return [*[p[3] * b[i] + q[3] * a[i] + c[i] for i in range(3)], p[3] * q[3] - dot(a, b)]


def conjugate(q: Vector) -> Vector:
    return [-q[0], -q[1], -q[2], q[3]]


def quaternion_inverse(q: Vector) -> Vector:
    n = dot(q, q)
    return [divide(x, n) for x in conjugate(q)]


def rotate(q: Vector, v: Vector) -> Vector:
    return quaternion_multiply(quaternion_multiply(q, [*v, F.lit(0.0)]), conjugate(q))[:3]


def quaternion_dcm(q: Vector) -> list[Vector]:
    i, j, k, s = q
    return [
        [s * s + i * i - j * j - k * k, 2 * (i * j - s * k), 2 * (i * k + s * j)],
        [2 * (i * j + s * k), s * s - i * i + j * j - k * k, 2 * (j * k - s * i)],
        [2 * (i * k - s * j), 2 * (j * k + s * i), s * s - i * i - j * j + k * k],
    ]


def roll(q: Vector) -> Column:
    i, j, k, s = q
    return F.atan2(2 * (s * i + j * k), 1 - 2 * (i * i + j * j))


def pitch(q: Vector) -> Column:
    i, j, k, s = q
    return F.asin(F.greatest(F.least(2 * (s * j - k * i), F.lit(1.0)), F.lit(-1.0)))


def yaw(q: Vector) -> Column:
    i, j, k, s = q
    return F.atan2(2 * (s * k + i * j), 1 - 2 * (j * j + k * k))


def angle_of_rotation(q: Vector) -> Column:
    return 2 * F.acos(F.greatest(F.least(q[3], F.lit(1.0)), F.lit(-1.0)))


def axis_of_rotation(q: Vector) -> Vector:
    s = F.sqrt(F.greatest(1 - q[3] * q[3], F.lit(0.0)))
    return [divide(x, s) for x in q[:3]]


def nlerp(p: Vector, q: Vector, share: Value) -> Vector:
    return normalize([a * (1 - col(share)) + b * col(share) for a, b in zip(p, q, strict=True)])


def slerp(p: Vector, q: Vector, share: Value) -> Vector:
    """Along the shorter great arc; nearly equal quaternions are blended linearly."""
    d = dot(p, q)
    near = [F.when(d < 0, -x).otherwise(x) for x in q]
    d = F.least(F.abs(d), F.lit(1.0))
    theta = F.acos(d)
    a, b = F.sin((1 - col(share)) * theta), F.sin(col(share) * theta)
    straight = nlerp(p, near, share)
    return [F.when(d > 0.9995, s).otherwise(divide(a * x + b * y, F.sin(theta))) for s, x, y in zip(straight, p, near, strict=True)]


def angular_velocity(p: Vector, q: Vector, dt: float) -> Vector:
    """Angular velocity that turns p into q within dt."""
    d = scale(quaternion_multiply(q, conjugate(p)), 2.0 / dt)
    return d[:3]


# ---- direction cosine matrices as lists of rows


def x_rotation(theta: Value) -> list[Vector]:
    c, s, o, z = F.cos(col(theta)), F.sin(col(theta)), F.lit(1.0), F.lit(0.0)
    return [[o, z, z], [z, c, -s], [z, s, c]]


def y_rotation(theta: Value) -> list[Vector]:
    c, s, o, z = F.cos(col(theta)), F.sin(col(theta)), F.lit(1.0), F.lit(0.0)
    return [[c, z, s], [z, o, z], [-s, z, c]]


def z_rotation(theta: Value) -> list[Vector]:
    c, s, o, z = F.cos(col(theta)), F.sin(col(theta)), F.lit(1.0), F.lit(0.0)
    return [[c, -s, z], [s, c, z], [z, z, o]]


def matrix_multiply(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [[dot(row, [r[j] for r in b]) for j in range(len(b[0]))] for row in a]


def euler_dcm(roll_: Value, pitch_: Value, yaw_: Value) -> list[Vector]:
    return matrix_multiply(z_rotation(yaw_), matrix_multiply(y_rotation(pitch_), x_rotation(roll_)))


def dcm_angles(m: list[Vector]) -> dict[str, Column]:
    return {"roll": F.atan2(m[2][1], m[2][2]), "pitch": -F.asin(F.greatest(F.least(m[2][0], F.lit(1.0)), F.lit(-1.0))), "yaw": F.atan2(m[1][0], m[0][0])}


def is_rotation(m: list[Vector], tolerance: float = 1e-9) -> Column:
    """Whether the rows are orthonormal and right-handed."""
    out = F.abs(dot(m[0], cross(m[1], m[2])) - 1) < tolerance
    for i in range(3):
        for j in range(i, 3):
            out &= F.abs(dot(m[i], m[j]) - float(i == j)) < tolerance
    return out


def wahba(rows: DataFrame, w: Vector, v: Vector, weight: Column | None = None) -> np.ndarray:
    """The rotation that best takes vectors v to w: nine sums over the rows, then one small SVD."""
    a = F.lit(1.0) if weight is None else weight
    sums = rows.agg(*[F.sum(a * w[i] * v[j]).alias(f"b{i}{j}") for i in range(3) for j in range(3)]).first()
    u, _, vt = np.linalg.svd(np.array([[sums[f"b{i}{j}"] for j in range(3)] for i in range(3)]))
    return u @ np.diag([1, 1, np.linalg.det(u) * np.linalg.det(vt)]) @ vt


# ---- celestial coordinates, in degrees


def ra_parts(degrees: Value) -> dict[str, Column]:
    """Hours, minutes and seconds of a right ascension of 0 to 360 degrees."""
    hours = col(degrees) / 15
    h = F.floor(hours)
    m = F.floor((hours - h) * 60)
    return {"hours": h, "minutes": m, "seconds": ((hours - h) * 60 - m) * 60}


def ra_degrees(hours: Value, minutes: Value, seconds: Value) -> Column:
    return (col(hours) + col(minutes) / 60 + col(seconds) / 3600) * 15


def dec_parts(degrees: Value) -> dict[str, Column]:
    """Sign, whole degrees, minutes and seconds of a declination of -90 to 90 degrees."""
    size = F.abs(col(degrees))
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return {"sign": F.when(col(degrees) < 0, -1).otherwise(1), "degrees": d, "minutes": m, "seconds": ((size - d) * 60 - m) * 60}


def dec_degrees(sign: Value, degrees: Value, minutes: Value, seconds: Value) -> Column:
    return col(sign) * (col(degrees) + col(minutes) / 60 + col(seconds) / 3600)


def to_xyz(ra: Value, dec: Value) -> Vector:
    r, d = F.radians(col(ra)), F.radians(col(dec))
    return [F.cos(r) * F.cos(d), F.sin(r) * F.cos(d), F.sin(d)]


def from_xyz(v: Vector) -> dict[str, Column]:
    ra = F.degrees(F.atan2(v[1], v[0]))
    return {"ra": F.when(ra < 0, ra + 360).otherwise(ra), "dec": F.degrees(F.asin(F.greatest(F.least(divide(v[2], norm(v)), F.lit(1.0)), F.lit(-1.0))))}


def radian_separation(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    return F.acos(F.greatest(F.least(dot(to_xyz(ra1, dec1), to_xyz(ra2, dec2)), F.lit(1.0)), F.lit(-1.0)))


def degree_separation(ra1: Value, dec1: Value, ra2: Value, dec2: Value) -> Column:
    return radian_separation(ra1, dec1, ra2, dec2) * (180 / math.pi)
