"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import global_rank
from pairloom.operators.skew import salted_join
from pairloom.scratch import Scratch


def distinct_pairs(df: DataFrame, a: str, b: str, scores: list[str]) -> DataFrame:
    """``(a, b, scores)``: one row per unordered pair of non-null ids, smaller id first.

    Null, NaN and infinite scores are unusable and become null; where copies of
    a pair differ, the highest usable score counts.
    """
    usable = [F.max(F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double"))).alias(c) for c in scores]
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(*usable)


def fuse_ranks(df: DataFrame, a: str, b: str, scores: list[str], constant: float = 0.1, k: float | None = None, min_usable: int = 2) -> DataFrame:
    """``(a, b, n_usable, fused, place)``: place 1 is the pair that stands highest on all scores.

    Pairs are ranked apart per score, higher first; equal values share the
    middle of their ranks. With N pairs usable on a score, its rank r counts
    ``1 / (constant * N + r)``: the constant is a share of N (the classic 60 is
    about 0.02 of 3,000), so a lead counts alike at any size of input and
    score. ``fused`` is the mean over a pair's usable scores of
    ``N / (constant * N + r)``, that is the sum with an unusable score counted
    as the mean of the others; pairs with fewer than ``min_usable`` have no
    row. ``k`` gives the classic form instead: the sum of ``1 / (k + r)`` over
    the usable scores. Ties in ``fused`` are ordered by ids. Empty input gives no rows.

    Ranks come from the distinct values with their counts, so a value that very
    many pairs share is one row there; bringing the ranks back is salted.
    """
    scratch = Scratch(df.sparkSession, "fusion")
    pairs = scratch.save(distinct_pairs(df, a, b, scores))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).alias("v")) for i, c in enumerate(scores)]))
    long = pairs.select("a", "b", each.alias("e")).select("a", "b", "e.s", "e.v").where("v IS NOT NULL")
    vals = long.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(vals, scratch, [F.desc("v")], "first", by=["s"], weight=F.col("n"))
    ranked = scratch.save(ranked.withColumn("rank", F.col("first") + (F.col("n") - 1) / 2))
    sizes = ranked.groupBy("s").agg(F.sum("n").alias("size"))  # one row per score
    ranked = ranked.join(F.broadcast(sizes), "s")
    held = ranked.agg(F.sum("n").alias("t")).scalar()
    back = salted_join(long, ranked, ["s", "v"], "n", held, F.concat("a", "b"))
    one = F.col("size") / (F.lit(constant) * F.col("size") + F.col("rank"))
    total = F.avg(one) if k is None else F.sum(1 / (F.lit(float(k)) + F.col("rank")))
    fused = back.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_usable"), F.round(total, 9).alias("fused")).where(F.col("n_usable") >= min_usable)
    return global_rank(fused, scratch, [F.desc("fused"), F.asc("a"), F.asc("b")], "place")


def top_share(df: DataFrame, a: str, b: str, scores: list[str], divisor: int = 50) -> DataFrame:
    """The ``count / divisor`` (rounded down) distinct pairs that stand highest."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return fuse_ranks(df, a, b, scores).where(F.col("place") <= F.floor(n / divisor))
