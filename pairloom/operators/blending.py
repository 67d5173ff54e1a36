"""Blending of model scores and alignment to a prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import clip01


def blend(overall: Column, first: Column, second: Column, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    """Half the overall score, half the weighted category scores; where one is missing, the overall."""
    own = F.coalesce(first * weights[0] + second * weights[1], overall)
    return overall * 0.5 + own * 0.5


def scaled(p: Column, category: Column, factors: dict[str, float]) -> Column:
    """Scores multiplied by their category's factor, then clipped to 0..1."""
    out = p
    for k, v in factors.items():
        out = F.when(category == k, p * v).otherwise(out)
    return clip01(out)


def aligned(p: Column, prior: Column, mean: Column) -> Column:
    """A score moved from the odds of ``mean`` to those of ``prior``."""
    up = p * prior * (1 - mean)
    return F.try_divide(up, up + (1 - p) * (1 - prior) * mean)


def align_to_prior(df: DataFrame, category: str, overall: str, scores: list[str]) -> DataFrame:
    """Each of ``scores`` aligned, per category, from its own mean to that of ``overall``."""
    means = df.groupBy(category).agg(F.avg(overall).alias("__prior"), *[F.avg(s).alias(f"__{s}") for s in scores])
    # one row per category
    out = df.join(means, category, "left")
    return out.withColumns({s: aligned(F.col(s), F.col("__prior"), F.col(f"__{s}")) for s in scores}).drop("__prior", *[f"__{s}" for s in scores])
