"""Words that tell apart pairs with like names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import latin_runs


def anti_words(negatives: DataFrame, a: str, b: str, longer_than: int = 2, top: int = 100) -> DataFrame:
    """``(word, n)``: the ``top`` Latin words that most often stand in only one of both names.

    Ties are ordered by word. Only words longer than ``longer_than`` count.
    """
    wa, wb = latin_runs(a), latin_runs(b)
    one_sided = negatives.select(F.explode(F.concat(F.array_except(wa, wb), F.array_except(wb, wa))).alias("word"))
    counts = one_sided.where(F.length("word") > longer_than).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(top)


def anti_word_score(a, b, words):
    """One-sided words that are anti-words, over the words of the richer name; 0 for no words."""
    wa, wb = latin_runs(a), latin_runs(b)
    hit = F.size(F.array_intersect(F.concat(F.array_except(wa, wb), F.array_except(wb, wa)), words))
    return F.coalesce(F.try_divide(hit.cast("double"), F.greatest(F.size(wa), F.size(wb))), F.lit(0.0))
