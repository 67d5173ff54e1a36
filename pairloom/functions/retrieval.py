"""Retrieval-style pair features: single-document BM25 and n-gram overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.5
# With one document every word's inverse document frequency is negative and is
# replaced by a quarter of the mean: ln(0.5 / 1.5) / 4.
IDF = 0.25 * math.log(1 / 3)


def bm25_single(query: Column, doc: Column) -> Column:
    """Score of query tokens (each occurrence) in a corpus of the one other text.

    Null where either side has no tokens. The length norm is 1.
    """

    def one(acc: Column, w: Column) -> Column:
        f = F.size(F.filter(doc, lambda d: d == w)).cast("double")
        return acc + F.lit(IDF * (K1 + 1)) * f / (f + K1)

    # counting only shared words keeps long texts from meeting word by word
    shared = F.filter(query, lambda q: F.array_contains(doc, q))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), F.aggregate(shared, F.lit(0.0), one))


def token_ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks, with repeats."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def multiset_f(a: Column, b: Column) -> Column:
    """F-score of the multisets' overlap; 0 where nothing is shared."""
    hit = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.coalesce(F.try_divide(2.0 * hit, F.size(a) + F.size(b)), F.lit(0.0))
