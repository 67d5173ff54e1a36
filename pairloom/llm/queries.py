"""Queries of this subpackage's operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.llm.components import link_groups
from pairloom.llm.distinctive import concentrated_terms, term_weights
from pairloom.llm.fusion import fuse_ranks, top_share
from pairloom.llm.leakage import leaks
from pairloom.llm.packing import pack
from pairloom.llm.products import product_groups, product_pairs
from pairloom.llm.residue import residue, without_residue
from pairloom.llm.splits import assign_splits, tied_groups
from pairloom.sources.tables import table

IDS = ("variantid_1", "variantid_2")
TEXTS = ["name_1", "description_1", "concat_keyval_1"]
PRODUCT = ("name_1", "description_1", "characteristic_attributes_mapping_1")
SCORES = ["userbge_cossim", "fasttext", "rubert_base_trained"]
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark, d):
    return concentrated_terms(table(spark, d, "train_df"), "variantid_1", TEXTS).select("variantid_1", "term")


def p1_weights(spark, d):
    w = term_weights(table(spark, d, "train_df"), "variantid_1", TEXTS)
    return w.select("variantid_1", "term", "tf", "df", F.round("weight", 6).alias("weight"))


def p3_found(spark, d):
    t = tied_groups(table(spark, d, "train_df"), "group_id", "is_double", *IDS)
    return t.select(F.col("group").alias("group_id"), F.col("unit").alias("unit_id"))


def p3_splits(spark, d):
    rows = table(spark, d, "train_df").select(*IDS, "group_id", "is_double")
    return assign_splits(rows, "group_id", "is_double", *IDS, SHARES).select(*IDS, "group_id", "is_double", "split")


def p3_whole(spark, d):
    """In how many splits each labelled group, and each group's ties, stand: one."""
    splits = p3_splits(spark, d).where("group_id <> -1").select("group_id", "split").distinct()
    units = p3_found(spark, d)
    tied = splits.join(units, "group_id", "left").withColumn("unit_id", F.coalesce("unit_id", "group_id"))
    n = tied.groupBy("unit_id").agg(F.count_distinct("split").cast("int").alias("n_splits"))
    return tied.select("group_id", "unit_id").distinct().join(n, "unit_id").select("group_id", "n_splits")


def p4_found(spark, d):
    pairs = product_pairs(product_groups(table(spark, d, "train_df"), "variantid_1", *PRODUCT))
    return pairs.select(F.col("a").alias("variantid_a"), F.col("b").alias("variantid_b"))


def p4_products(spark, d):
    """One row per listing: the scalable form of the grouping."""
    groups = product_groups(table(spark, d, "train_df"), "variantid_1", *PRODUCT)
    return groups.select(F.col("id").alias("variantid_1"), "product")


def p5_found(spark, d):
    found = link_groups(table(spark, d, "train_df").where("is_double = 1").select(*IDS), *IDS)
    return found.select(F.col("id").alias("variantid"), "group_key")


def p6_found(spark, d):
    return top_share(table(spark, d, "test_df"), *IDS, SCORES).select(F.col("a").alias("variantid_a"), F.col("b").alias("variantid_b"))


def p6_ranking(spark, d):
    return fuse_ranks(table(spark, d, "test_df"), *IDS, SCORES).select(F.col("a").alias("variantid_a"), F.col("b").alias("variantid_b"), "n_usable", F.round("fused", 6).alias("fused"))


def p8_pack(spark, d):
    return pack(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_whole(spark, d):
    """What packing left out of each document, and its pieces in containers over capacity: nothing."""
    capacity = 2048
    packed = pack(table(spark, d, "documents"), "doc_id", "text", capacity)
    over = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("load")).where(F.col("load") > capacity).select("container", F.lit(1).alias("over"))
    last = F.max(F.coalesce(F.col("start_token") + F.col("n_tokens"), F.lit(0)))
    per = packed.join(over, "container", "left").groupBy(F.col("id").alias("doc_id"))
    return per.agg((last - F.sum(F.coalesce("n_tokens", F.lit(0)))).cast("long").alias("n_missing"), F.count("over").alias("n_over"))


def p9_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark, d):
    return residue(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark, d):
    """The corpus without the documents of ``p10_found``."""
    return without_residue(table(spark, d, "documents")).select("doc_id", "lang", "source", "text")


_ALL = (p1_found, p1_weights, p3_found, p3_splits, p3_whole, p4_found, p4_products, p5_found, p6_found, p6_ranking, p8_pack, p8_whole, p9_found, p10_found, p10_clean)
QUERIES = {f.__name__: f for f in _ALL}

_TERMS = """
    r AS (SELECT variantid_1, min(concat_ws(' ', coalesce(name_1, ''), coalesce(description_1, ''), coalesce(concat_keyval_1, ''))) AS t
          FROM train_df WHERE variantid_1 IS NOT NULL GROUP BY 1),
    x AS (SELECT variantid_1, lower(unnest(regexp_extract_all(t, '[\\p{L}\\p{N}]{3,}'))) AS term FROM r),
    c AS (SELECT variantid_1, term, count(*) AS tf FROM x GROUP BY 1, 2),
    s AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY 1),
    n AS (SELECT count(*)::DOUBLE AS n FROM r)"""

_FUSED = """
    p AS (SELECT least(variantid_1, variantid_2) AS a, greatest(variantid_1, variantid_2) AS b,
                 max(CASE WHEN isfinite(userbge_cossim) THEN userbge_cossim END) AS s0,
                 max(CASE WHEN isfinite(fasttext) THEN fasttext END) AS s1,
                 max(CASE WHEN isfinite(rubert_base_trained) THEN rubert_base_trained END) AS s2
          FROM test_df WHERE variantid_1 IS NOT NULL AND variantid_2 IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT a, b, 0 AS s, s0 AS v FROM p UNION ALL SELECT a, b, 1, s1 FROM p UNION ALL SELECT a, b, 2, s2 FROM p),
    g AS (SELECT a, b, rank() OVER (PARTITION BY s ORDER BY v DESC) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0 AS r,
                 count(*) OVER (PARTITION BY s) AS n FROM l WHERE v IS NOT NULL),
    f AS (SELECT a, b, count(*) AS n_usable, round(avg(n / (0.1 * n + r)), 9) AS fused FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"""

SQL = {
    "p1_found": f"WITH {_TERMS} SELECT variantid_1, term FROM c JOIN s USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5",
    "p1_weights": f"""WITH {_TERMS} SELECT variantid_1, term, tf, df,
        round(tf * (-log2(df / n) + log2(1 - exp(-cf / n))), 6) AS weight FROM c JOIN s USING (term) CROSS JOIN n""",
    "p5_found": """
        WITH RECURSIVE e AS (
            SELECT variantid_1 AS a, variantid_2 AS b FROM train_df WHERE is_double = 1 AND variantid_1 <> variantid_2
            UNION SELECT variantid_2, variantid_1 FROM train_df WHERE is_double = 1 AND variantid_1 <> variantid_2
        ), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS variantid, min(b) AS group_key FROM r GROUP BY 1""",
    "p3_found": """
        WITH RECURSIVE s AS (
            SELECT variantid_1 AS v, group_id AS g FROM train_df WHERE is_double = 1 AND group_id <> -1
            UNION SELECT variantid_2, group_id FROM train_df WHERE is_double = 1 AND group_id <> -1
        ), e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM s x JOIN s y ON x.v = y.v AND x.g <> y.g),
        r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS group_id, min(b) AS unit_id FROM r GROUP BY 1""",
    "p3_whole": "SELECT DISTINCT group_id, 1 AS n_splits FROM train_df WHERE is_double IN (0, 1) AND group_id <> -1",
    "p8_whole": "SELECT doc_id, 0 AS n_missing, 0 AS n_over FROM documents WHERE text IS NOT NULL",
    "p6_ranking": f"WITH {_FUSED} SELECT a AS variantid_a, b AS variantid_b, n_usable, round(fused, 6) AS fused FROM f",
    "p6_found": f"WITH {_FUSED} SELECT a AS variantid_a, b AS variantid_b FROM f QUALIFY row_number() OVER (ORDER BY fused DESC, a, b) <= (SELECT count(*) FROM p) // 50",
}
