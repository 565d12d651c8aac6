"""Vectors, angles, ranks and rounding as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.bround(x, 0).cast("long")


def even(x: Column) -> Column:
    return x - F.pmod(x, F.lit(2))


def norm(*xs: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b, strict=True)])


def normalised(xs: list[Column], least: float = 1e-9) -> list[Column]:
    """The unit vector, or zeros for a vector without length."""
    n = norm(*xs)
    return [F.when(n > least, x / n).otherwise(F.lit(0.0)) for x in xs]


def quat_multiply(p: list[Column], q: list[Column]) -> list[Column]:
    """Hamilton product of (w, x, y, z)."""
    a, b, c, d = p
    e, f, g, h = q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def quat_conjugate(q: list[Column]) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def quat_rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """The vector turned by the quaternion (w, x, y, z): v + 2w(u x v) + 2u x (u x v)."""
    w, u = q[0], q[1:]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    once = cross(u, v)
    twice = cross(u, once)
    return [x + 2 * w * y + 2 * z for x, y, z in zip(v, once, twice, strict=True)]


def roll_angle(side: Column, down: Column) -> Column:
    """Degrees of roll from the gravity components across and down the picture."""
    return F.degrees(F.atan2(side, down))


def rotate_offset(du: Column, dv: Column, degrees: Column) -> Column:
    """Where an offset from the frame centre lies horizontally once the frame is turned back by degrees."""
    a = F.radians(-degrees)
    return du * F.cos(a) - dv * F.sin(a)


def to_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(x, y): equirectangular metres from an origin."""
    return F.struct(((lon - lon0) * 111_320.0 * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * 111_132.0).alias("y"))


def at_or_below(value: Column, breaks: Column, n: int = 101) -> Column:
    """How many of n ascending breaks are at or below the value: a binary search as a fold."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(breaks, at + s - 1) <= value), at + s).otherwise(at))


def rank_interp(value: Column, breaks: Column, n: int = 101) -> Column:
    """Percentile rank 0..1 by linear interpolation in n evenly spaced percentile breaks, clamped at both ends."""

    def of(at: Column) -> Column:
        lo, hi = F.get(breaks, at - 1), F.get(breaks, at)
        inner = (at - 1 + (value - lo) / F.nullif(hi - lo, F.lit(0.0))) / (n - 1)
        return F.when(at <= 0, F.lit(0.0)).when(at >= n, F.lit(1.0)).otherwise(inner)

    found = F.get(F.transform(F.array(at_or_below(value, breaks, n)), of), F.lit(0))
    return F.when(value.isNotNull() & breaks.isNotNull(), found)


def rising(breaks: Column) -> Column:
    """The running maximum of an array."""
    return F.aggregate(breaks, F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.greatest(F.coalesce(F.get(out, F.size(out) - 1), x), x))))


def availability_key(present: list[Column]) -> Column:
    """Bitmask of the features present, the first in bit 0."""
    return reduce(lambda a, b: a + b, [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(present)])


def power_mean(values: list[Column], weights: list[float], p: float) -> Column:
    """Weighted power mean of the values present, clipped to 0..1; null if none is. A weight of zero is absence."""
    used = [(v, w) for v, w in zip(values, weights, strict=True) if w > 0]
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in used])
    powered = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w) * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(p))).otherwise(F.lit(0.0)) for v, w in used])
    return F.when(total > 0, F.pow(powered / total, F.lit(1.0 / p)))
