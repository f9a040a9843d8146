"""Geometry on position columns. A point is a list of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = list[Column]


def minus(a: Point, b: Point) -> Point:
    return [p - q for p, q in zip(a, b)]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def angle(a: Point, b: Point, c: Point) -> Column:
    """At b, in radians."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (norm(u) * norm(v)))))


def dihedral(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Around b-c, in radians, -pi to pi."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(u, v), cross(v, w)
    return F.atan2(dot(u, n2) * norm(v), dot(n1, n2))


def dihedral_phase(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The dihedral less pi, brought back to -pi to pi."""
    p = dihedral(a, b, c, d) - math.pi
    return F.when(p < -math.pi, p + 2 * math.pi).when(p > math.pi, p - 2 * math.pi).otherwise(p)


def decay_force(d: Column, low: float, up: float, rate: float, power: float, base: float, minimum: float) -> Column:
    """Elastic force constant: decays beyond `low`, none beyond `up` or below `minimum`, at most `base`."""
    f = base * F.exp(-rate * F.pow(d - low, F.lit(float(power))))
    return F.when(d > up, F.lit(0.0)).when(f < minimum, F.lit(0.0)).when(f > base, F.lit(float(base))).otherwise(f)


def sigma_from_distance(d: Column) -> Column:
    """The Lennard-Jones sigma whose minimum lies at d."""
    return d / F.lit(2 ** (1 / 6))


def c6_c12(sigma: Column, epsilon: Column) -> tuple[Column, Column]:
    s6 = F.pow(sigma, F.lit(6.0))
    return 4 * epsilon * s6, 4 * epsilon * s6 * s6


def fibonacci_sphere(n: int) -> list[tuple[float, float, float]]:
    """n points spread evenly over the unit sphere."""
    golden = math.pi * (3 - math.sqrt(5))
    out = []
    for i in range(n):
        y = (i + 0.5) * 2 / n - 1
        r = math.sqrt(max(0.0, 1 - y * y))
        out.append((math.cos(golden * i) * r, y, math.sin(golden * i) * r))
    return out


def quantise(c: Column, scale: float = 1e6) -> Column:
    """Rounded in a way that every engine does alike."""
    return F.floor(c * scale + 0.5) / scale
