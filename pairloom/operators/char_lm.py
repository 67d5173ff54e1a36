"""A character 5-gram model: counts, backed-off probabilities and perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_lookup
from pairloom.scratch import Scratch

ORDER = 5
BACKOFF = 0.4


def letters(c: Column | str) -> Column:
    """The lower-case runs of letters of two alphabets, joined by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-zа-я]+"), F.lit(0)), " ")


PIECE = 200  # characters


def gram_counts(df: DataFrame, text: str, order: int = ORDER, least: int = 1) -> DataFrame:
    """``(gram, n)`` of all runs of ``least`` to ``order`` characters. Null and empty texts give none.

    Long texts are cut into pieces that overlap by what a run may reach over,
    so that work grows with their length; no run is lost or counted twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work a row: not to be coalesced by size
    t = df.select(letters(text).alias("t")).where(F.length("t") > 0).repartition(parts)
    pieces = t.select("t", F.explode(F.sequence(F.lit(1), F.length("t"), F.lit(PIECE))).alias("at")).select(F.substr("t", F.col("at"), F.lit(PIECE + order - 1)).alias("p"))
    p = pieces.withColumn("size", F.length("p"))
    lengths = lambda i: F.filter(F.array(*map(F.lit, range(least, order + 1))), lambda k: k <= F.col("size") - i + 1)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least("size", F.lit(PIECE))), lambda i: F.transform(lengths(i), lambda k: F.substr("p", i, k))))
    return p.select(F.explode(runs).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def perplexity(df: DataFrame, text: str, counts: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """``(text, n_chars, perplexity)`` of every distinct text; null for a text without letters.

    A character's probability comes from the longest run that ends in it and
    was counted: its count over that of the run without it, times 0.4 for each
    character that had to be left out. A character that was never counted has
    one over the number of all plus one. Each window of characters is scored
    once, however often it stands in the texts.
    """
    texts = scratch.save(df.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().withColumn("t", letters("text")))
    window = lambda i: F.substr("t", F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order)))
    at = texts.where(F.length("t") > 0).select("text", F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), window)).alias("w"))
    windows = scratch.save(at.groupBy("text", "w").agg(F.count(F.lit(1)).alias("k")))
    single = counts.where(F.length("gram") == 1).agg(F.sum("n").alias("n")).scalar()
    cut = windows.select("w").distinct().select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    cut = cut.select("w", "k", F.right("w", F.col("k")).alias("gram")).withColumn("context", F.substr("gram", F.lit(1), F.col("k") - 1))
    # short runs stand in very many windows
    hit = salted_lookup(cut, counts.withColumnRenamed("n", "c"), ["gram"], F.col("w"))
    hit = salted_lookup(hit, counts.select(F.col("gram").alias("context"), F.col("n").alias("c0")), ["context"], F.col("w"), "left")
    best = hit.groupBy("w").agg(F.max(F.struct("k", "c", "c0")).alias("b"))
    p = F.coalesce(F.col("b.c") / F.coalesce("b.c0", single) * F.pow(F.lit(BACKOFF), F.length("w") - F.col("b.k")), 1.0 / (single + 1))
    scored = windows.select("w").distinct().join(best, "w", "left").select("w", F.log(p).alias("lp"))
    both = salted_lookup(windows, scored, ["w"], F.col("text"))
    sums = both.groupBy("text").agg(F.sum("k").alias("n_chars"), F.sum(F.col("k") * F.col("lp")).alias("s"))
    return texts.select("text").join(sums, "text", "left").select("text", "n_chars", F.exp(-F.col("s") / F.col("n_chars")).alias("perplexity"))
