"""Vector columns held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """Vector scaled to length one."""
    # The length is an argument of its own, so it is computed once and not per element.
    n = F.array_repeat(F.greatest(norm(a), F.lit(eps)), F.size(a))
    return F.zip_with(a, n, lambda x, y: x.cast("double") / y)


def blend(a: Column, b: Column, alpha: float) -> Column:
    """Unit vector of ``alpha * a + (1 - alpha) * b``."""
    mixed = F.zip_with(unit(a), unit(b), lambda x, y: F.lit(alpha) * x + F.lit(1.0 - alpha) * y)
    return unit(mixed)
