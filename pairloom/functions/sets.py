"""Set, multiset and prefix similarities as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where there are none. Nulls count as empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least), F.lit(0.0))


def ngram_iou(a: Column, b: Column) -> Column:
    """``jaccard``, but 0 where either side is empty (the union then has no shared part)."""
    return jaccard(a, b)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def shared_chars(a: Column, b: Column) -> Column:
    """Size of the common character multiset: how often each shared character stands in a text tells its length without it."""
    times = lambda t, x: F.length(t) - F.length(F.replace(t, x, F.lit("")))
    return F.aggregate(F.array_intersect(chars(a), chars(b)), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))


def dice(a: Column, b: Column) -> Column:
    """Twice the common over all characters, as multisets; equal texts (also empty) give 1, nulls null."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.try_divide(2.0 * shared_chars(a, b), F.length(a) + F.length(b)))


def tanimoto(a: Column, b: Column) -> Column:
    """Binary logarithm of the multiset Jaccard; null where nothing is shared (minus infinity)."""
    s = shared_chars(a, b)
    return F.when(a == b, F.lit(0.0)).otherwise(F.log2(F.when(s > 0, s / (F.length(a) + F.length(b) - s))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix over the shorter length; 0 where one is empty."""
    n = F.least(F.length(a), F.length(b))
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, F.lit(0.0)).otherwise(F.size(firsts) / n.cast("double"))
