"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a null side or a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def power_mean(a: Column, p: float = 3.0) -> Column:
    """Generalised mean of non-negative entries; negative ones count as a tiny positive number."""
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.pow(F.greatest(x.cast("double"), F.lit(1e-6)), F.lit(p)))
    return F.pow(s / F.size(a), F.lit(1.0 / p))
