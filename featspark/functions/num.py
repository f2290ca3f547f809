"""Numeric column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio(a, b) -> Column:
    """a / b as double, NULL when b is 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Correlation from sufficient statistics; NULL when one side is constant."""
    n, sx, sy, sxx, syy, sxy = map(c, (n, sx, sy, sxx, syy, sxy))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # cancellation noise of a constant column is of the order eps * n * sxx
    flat = (vx <= n * sxx * 1e-13) | (vy <= n * syy * 1e-13)
    return F.when(~flat, F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def pearson_agg(x, y) -> Column:
    """Correlation as one aggregate expression over rows where both sides are present."""
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return pearson(F.count(x).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))


def share(cond) -> Column:
    """Fraction of rows where the condition holds (NULL condition counts as not held)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_if(cond) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, [c(x) for x in cols])


def clip(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c(x)))


def lookup(key, table: dict, default=None) -> Column:
    """Value of a small fixed table (at most a few dozen entries) as a literal map lookup."""
    entries = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    hit = F.try_element_at(entries, c(key))
    return hit if default is None else F.coalesce(hit, F.lit(default))
