"""Numeric pair features and clean-up as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_LIMIT = 2**64 - 2


def ratios(a: Column, b: Column) -> tuple[Column, Column]:
    """``a / b`` and ``b / a``; null for a null side or a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.try_divide(a, b), F.try_divide(b, a)


def word_count_ratios(a: Column, b: Column) -> tuple[Column, Column]:
    """Ratios of white-space word counts; null counts 0, a zero divisor gives 0."""
    na, nb = (F.coalesce(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.lit(0)).cast("double") for c in (a, b))
    zero = F.lit(0.0)
    return F.coalesce(F.try_divide(na, nb), zero), F.coalesce(F.try_divide(nb, na), zero)


def abs_diff(a: Column, b: Column) -> Column:
    """Absolute difference of the whole parts."""
    return F.abs(a.cast("long") - b.cast("long"))


def sq_diff(a: Column, b: Column) -> Column:
    """Squared difference of the whole parts, at most 2^64 - 2."""
    d = (a.cast("long") - b.cast("long")).cast("decimal(18,0)")
    # least skips nulls, so a null difference is kept apart
    return F.when(d.isNotNull(), F.least(d * d, F.lit(str(U64_LIMIT)).cast("decimal(38,0)"))).cast("decimal(20,0)")


def fillness(a: Column, b: Column) -> Column:
    """``both``, ``none`` or ``only one``, by what is not null."""
    return F.when(a.isNotNull() & b.isNotNull(), "both").when(a.isNull() & b.isNull(), "none").otherwise("only one")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
