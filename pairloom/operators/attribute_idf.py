"""How informative attribute keys are within a category, and features from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import Scratch


def attribute_idf(items: DataFrame, category: str, entries: str) -> DataFrame:
    """``(category, key, n_items, score)``: (c / n) * ln(c / d) per category and key.

    n counts the category's items (also those without attributes), c those with
    the key, d the key's distinct values. Null categories are left out.
    """
    rows = items.where(F.col(category).isNotNull())
    n = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n_items"))
    kv = rows.select(category, F.explode(entries).alias("e")).select(category, F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    # distinct values are counted from per-value sums, so a hot key's rows fold before they move
    per_value = kv.groupBy(category, "key", "value").agg(F.count(F.lit(1)).alias("c"))
    per_key = per_value.groupBy(category, "key").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    score = F.col("c") / F.col("n_items") * F.log(F.col("c") / F.col("d"))
    # one row per category on the right
    return per_key.join(n, category).select(category, "key", "n_items", score.alias("score"))


def attribute_idf_levels(items: DataFrame, categories: list[str], entries: str, scratch: Scratch) -> DataFrame:
    """``(level, category, key, n_items, score)``: ``attribute_idf`` of several category levels in one pass.

    Items are counted per combination of categories first; only those counts
    are repeated for each level.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("category")) for k, c in enumerate(categories, 1)])).alias("l")
    items = scratch.save(items.select(*categories, entries))
    sizes = items.groupBy(*categories).agg(F.count(F.lit(1)).alias("c"))
    n = sizes.select(levels, "c").where("l.category IS NOT NULL").groupBy("l.level", "l.category").agg(F.sum("c").alias("n_items"))
    kv = items.select(*categories, F.explode(entries).alias("e")).groupBy(*categories, "e.key", "e.value").agg(F.count(F.lit(1)).alias("c"))
    per_value = kv.select(levels, "key", "value", "c").where("l.category IS NOT NULL").groupBy("l.level", "l.category", "key", "value").agg(F.sum("c").alias("c"))
    per_key = per_value.groupBy("level", "category", "key").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    score = F.col("c") / F.col("n_items") * F.log(F.col("c") / F.col("d"))
    # one row per category on the right
    return per_key.join(n, ["level", "category"]).select("level", "category", "key", "n_items", score.alias("score"))


def ranked_keys(idf: DataFrame, category: str, top: int) -> DataFrame:
    """``(category, top)``: each category's best ``top`` keys, score then key descending, as an array."""
    w = Window.partitionBy(category).orderBy(F.desc("score"), F.desc("key"))
    best = idf.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    # at most ``top`` entries per category
    return best.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("rk", "key", "score"))).alias("top"))


def match_flags(m1, m2, same_category, top, size: int):
    """0 or 1 for each of ``size`` ranked keys: present on both sides with equal values."""
    at = F.sequence(F.lit(0), F.lit(size - 1))

    def one(i):
        k = F.get(top, i)["key"]
        return F.coalesce((same_category & (F.element_at(m1, k) == F.element_at(m2, k))).cast("int"), F.lit(0))

    return F.transform(at, one)


def weighted_share(m1, m2, same_category, top, cut: int):
    """Weight of matching keys over all weight among the first ``cut`` ranked keys; 0 without weight."""
    part = F.slice(top, 1, cut)
    total = F.aggregate(part, F.lit(0.0), lambda acc, e: acc + e["score"])
    hit = F.aggregate(part, F.lit(0.0), lambda acc, e: acc + F.when(F.coalesce(F.element_at(m1, e["key"]) == F.element_at(m2, e["key"]), F.lit(False)), e["score"]).otherwise(0.0))
    return F.when(F.coalesce(same_category, F.lit(False)) & (total > 0), hit / total).otherwise(0.0)


def equal_keys(m1, m2):
    """Keys that both maps hold with equal values; null for a null map."""
    return F.filter(F.map_keys(m1), lambda k: F.element_at(m1, k) == F.element_at(m2, k))


def cut_weights(top, cuts):
    """Weight of the first ranked keys, for each of ``cuts``."""
    return F.array(*[F.aggregate(F.slice(top, 1, n), F.lit(0.0), lambda acc, e: acc + e["score"]) for n in cuts])


def ranked_hits(equal, same_category, top):
    """The ranked keys among ``equal``, in their order; none across categories."""
    return F.when(same_category, F.filter(top, lambda e: F.array_contains(equal, e["key"])))


def hit_share(hits, weights, place: int, cut: int):
    """``weighted_share`` from ``ranked_hits`` and the category's ``cut_weights``, of which it takes the one at ``place``."""
    hit = F.aggregate(F.filter(hits, lambda e: e["rk"] <= cut), F.lit(0.0), lambda acc, e: acc + e["score"])
    return F.coalesce(F.when(F.get(weights, F.lit(place)) > 0, hit / F.get(weights, F.lit(place))), F.lit(0.0))
