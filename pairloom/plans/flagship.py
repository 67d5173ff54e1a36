"""The flagship query: each category's likeliest duplicates by native features alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions import sets as S
from pairloom.functions import text as T
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.plans.features import _kv, _s_grams, _s_intersect, _s_kv, _s_toks, _toks

R = Registry()
TOP = 10


def _s_jaccard(a, b):
    return f"coalesce(len({_s_intersect(a, b)})::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


_S_SCORE = (
    f"round(0.4 * {_s_jaccard(_s_toks('name_1'), _s_toks('name_2'))} + 0.3 * {_s_jaccard(_s_grams('name_1', 3), _s_grams('name_2', 3))}"
    f" + 0.3 * {_s_jaccard(_s_kv('concat_keyval_1'), _s_kv('concat_keyval_2'))}, 6)"
)


@R.add(
    f"""WITH p AS (SELECT DISTINCT variantid_1, variantid_2, unique_cat_1, name_1, name_2, concat_keyval_1, concat_keyval_2 FROM train_df WHERE variantid_1 <> variantid_2),
    s AS (SELECT unique_cat_1, variantid_1, variantid_2, {_S_SCORE} AS score FROM p)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY unique_cat_1 ORDER BY score DESC, variantid_1, variantid_2) <= {TOP}"""
)
def likely_duplicates(spark, d):
    """Top ten pairs per category by word, trigram and attribute overlap.

    The rank filter is pushed below the shuffle as a window group limit, so a
    category that holds most pairs sends ten rows per task.
    """
    p = pairs(spark, d).where("variantid_1 <> variantid_2").select(*IDS, "unique_cat_1", "name_1", "name_2", "concat_keyval_1", "concat_keyval_2").distinct()
    # much work a row: not to be coalesced by size
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *IDS)
    names = S.jaccard(F.array_distinct(_toks("name_1")), F.array_distinct(_toks("name_2")))
    grams = S.ngram_iou(T.char_ngrams("name_1", 3), T.char_ngrams("name_2", 3))
    score = r6(names * 0.4 + grams * 0.3 + S.jaccard(_kv("concat_keyval_1"), _kv("concat_keyval_2")) * 0.3)
    w = Window.partitionBy("unique_cat_1").orderBy(F.desc("score"), *IDS)
    return p.select("unique_cat_1", *IDS, score.alias("score")).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= TOP).drop("rk")
