"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """``keys`` and ``__salts`` (2 or more) of each key with over ``1 / parts`` of the rows: fewer than ``parts`` of them."""
    return hot_of(df.where(_whole(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "__n", parts)


def hot_of(sizes: DataFrame, keys: list[str], n: str, parts: int = 1000) -> DataFrame:
    """``hot_keys`` where the rows of each key are already counted, in column ``n``."""
    total = sizes.agg(F.sum(n)).scalar()
    return sizes.select(*keys, F.ceil(F.col(n) * parts / total).cast("int").alias("__salts")).where("__salts > 1")


def spread_rows(df: DataFrame, hot: DataFrame, keys: list[str], spread: Column, parts: int = 1000) -> DataFrame:
    """``df`` with ``__salt``: rows of hot keys over their salts by the hash of ``spread``, rows without key over all."""
    # fewer than ``parts`` rows
    out = df.join(F.broadcast(hot), keys, "left")
    salts = F.when(_whole(keys), F.coalesce("__salts", F.lit(1))).otherwise(F.lit(parts))
    return out.withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")


def repeat_rows(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``__salt``: rows of hot keys once for each of their salts."""
    out = df.join(F.broadcast(hot), keys, "left")
    return out.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", parts: int = 1000, hot: DataFrame | None = None) -> DataFrame:
    """Join of ``left`` with the rows of its keys in ``right``, keys that hold most rows of ``left`` split.

    The hot keys are counted in ``left`` (aggregated before the shuffle) where
    they are not given. ``how``
    is ``inner``, ``left`` or ``left_anti``; rows are those of the plain join.
    """
    hot = hot_keys(left, keys, parts) if hot is None else hot
    return spread_rows(left, hot, keys, spread, parts).join(repeat_rows(right, hot, keys), [*keys, "__salt"], how).drop("__salt")


def _whole(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: Column, spread: Column, parts: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key.

    ``weight`` (a column of ``right``) is the number of left rows of its key and
    ``total`` their sum. A key with more than ``total / parts`` rows is hot;
    there are fewer than ``parts`` of those, so their list is broadcast, their
    left rows are spread over salts by the hash of ``spread``, and their right
    row is repeated once per salt. Every other key is joined as it is. One pass
    over ``left``; no row is dropped or capped. Null keys match nothing.
    """
    share = F.ceil(F.col(weight) * parts / total).cast("int")
    salted = right.withColumn("__salts", share)
    hot = salted.where(F.col("__salts") > 1).select(*keys, "__salts")
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = salted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def salted_pairs(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, parts: int = 1000) -> DataFrame:
    """Inner join of two frames that both may hold many rows of a key.

    A key with more than ``1 / parts`` of all result rows is hot: its left rows
    are spread over salts by the hash of ``spread`` (of left columns) and its
    right rows are repeated once per salt, so each task gets a share of the
    result. There are fewer than ``parts`` hot keys; their list is broadcast.
    Rows are those of the plain join; null keys match nothing.
    """
    l, r = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "__l"), (right, "__r")))
    sizes = l.join(r, keys).select(*keys, (F.col("__l") * F.col("__r")).alias("__n"))
    total = sizes.agg(F.sum("__n")).scalar()
    hot = F.broadcast(sizes.select(*keys, F.ceil(F.col("__n") * parts / total).cast("int").alias("__salts")).where("__salts > 1"))
    left = left.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
