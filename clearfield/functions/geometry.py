"""Scalar geometry as column expressions, and small exact statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def plane_value(normal: tuple[Column, ...], offset: Column, p: tuple[Column, ...]) -> Column:
    """normal . p - offset, summed from left to right."""
    return dot(normal, p) - offset


def same_plane(n: tuple[Column, ...], offset: Column, m: tuple[Column, ...], other: Column, tolerance: float) -> Column:
    """Whether two unit-normal planes are one: normals within 1e-12 of parallel, offsets within tolerance."""
    return (dot(n, m) >= 1 - 1e-12) & (F.abs(offset - other) <= tolerance)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a proportion; 0 to 1 where n is 0."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def ray_ellipsoid(origin: tuple[Column, ...], direction: tuple[Column, ...], centre: tuple[float, ...], radii: tuple[float, ...]) -> Column:
    """Distance along a ray to an ellipsoid: the near root if positive, else the far one; null if it is missed."""
    o = tuple((x - F.lit(c)) / F.lit(r) for x, c, r in zip(origin, centre, radii, strict=True))
    d = tuple(x / F.lit(r) for x, r in zip(direction, radii, strict=True))
    a, b, c = dot(d, d), 2 * dot(o, d), dot(o, o) - 1
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    near, far = (-b - root) / (2 * a), (-b + root) / (2 * a)
    return F.when(disc >= 0, F.when(near > 0, near).when(far > 0, far))


def inside_ellipsoid(p: tuple[Column, ...], centre: tuple[float, ...], radii: tuple[float, ...]) -> Column:
    q = tuple((x - F.lit(c)) / F.lit(r) for x, c, r in zip(p, centre, radii, strict=True))
    return dot(q, q) <= 1


def inside_box(p: tuple[Column, ...], lo: tuple[float, ...], hi: tuple[float, ...]) -> Column:
    out = F.lit(True)
    for x, a, b in zip(p, lo, hi, strict=True):
        out = out & x.between(a, b)
    return out


def union_volume(boxes: list[tuple[tuple[float, float, float], tuple[float, float, float]]]) -> float:
    """Volume of a union of a few boxes (lo, hi), by inclusion and exclusion."""
    total = 0.0
    for mask in range(1, 1 << len(boxes)):
        chosen = [b for i, b in enumerate(boxes) if mask >> i & 1]
        sides = [max(0.0, min(b[1][k] for b in chosen) - max(b[0][k] for b in chosen)) for k in range(3)]
        total += math.prod(sides) * (1 if len(chosen) % 2 else -1)
    return total
