"""Vector geometry as Column expressions over array<double>.

Everything stays in the JVM. A null vector gives null; positions count from 0 in names, from 1 in
element_at. EPS values are shared with the codecs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The floor of norms at sources and inside codecs.
SOURCE_EPS, CODEC_EPS = 1e-12, 1e-7


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled(v: Column, eps: float = CODEC_EPS) -> Column:
    """v at length 1; a vector shorter than eps is divided by eps, so zeros stay zeros."""
    # the length is worked out once: lambdas see it as the only element of an outer array
    length = F.greatest(norm(v), F.lit(eps))
    return F.element_at(F.transform(F.array(length), lambda n: F.transform(v, lambda x: x / n)), 1)


def tails(v: Column) -> Column:
    """Norms of v[i:] for every i."""
    sums = F.aggregate(F.reverse(v), F.array().cast("array<double>"), lambda acc, x: F.concat(F.array(F.coalesce(F.try_element_at(acc, F.lit(1)), F.lit(0.0)) + x * x), acc))
    return F.transform(sums, lambda s: F.sqrt(s))


def to_angles(v: Column, dim: int, eps: float = CODEC_EPS) -> Column:
    """Hyperspherical angles of a vector of `dim` >= 2 numbers: dim - 2 in [0, pi], the last in [0, 2 pi)."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    head = F.slice(F.zip_with(v, tails(v), lambda x, t: F.acos(clamp(x / F.greatest(t, F.lit(eps))))), 1, dim - 2)
    turn = F.atan2(F.element_at(v, dim), F.element_at(v, dim - 1))
    return F.concat(head, F.array(turn + F.when(turn < 0, F.lit(2 * math.pi)).otherwise(F.lit(0.0))))


def from_angles(a: Column, renormalise: bool = True) -> Column:
    """The unit vector with these angles."""
    sines = F.aggregate(a, F.array(F.lit(1.0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) * F.sin(t))))
    v = F.zip_with(sines, F.concat(F.transform(a, lambda t: F.cos(t)), F.array(F.lit(1.0))), lambda s, c: s * c)
    return scaled(v) if renormalise else v


def log_sensitivities(a: Column, eps: float = CODEC_EPS) -> Column:
    """For each angle, the sum of log sin^2 over the angles before it."""
    sums = F.aggregate(a, F.array(F.lit(0.0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + 2 * F.log(F.greatest(F.abs(F.sin(t)), F.lit(eps))))))
    return F.slice(sums, 1, F.size(a))


def ranges(dim: int) -> list[float]:
    """The upper ends of the angles' ranges."""
    return [math.pi] * (dim - 2) + [2 * math.pi]


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
