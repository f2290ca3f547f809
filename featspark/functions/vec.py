"""Vector expressions over ARRAY<DOUBLE> columns, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import c


def asum(a) -> Column:
    return F.aggregate(c(a), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return asum(F.zip_with(c(a), c(b), lambda x, y: x * y))


def sq_norm(a) -> Column:
    return F.aggregate(c(a), F.lit(0.0), lambda s, v: s + v * v)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def normalize(a, eps: float = 1e-12) -> Column:
    size = F.greatest(norm(a), F.lit(eps))
    return F.transform(c(a), lambda v: v / size)


def diff_norm(a, b) -> Column:
    return F.sqrt(asum(F.zip_with(c(a), c(b), lambda x, y: (x - y) * (x - y))))


def mean(a) -> Column:
    return asum(a) / F.size(c(a))


def cross3(a, b):
    """Cross product of two (x, y, z) tuples of columns."""
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot3(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub3(a, b):
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def norm3(a) -> Column:
    return F.sqrt(dot3(a, a))
