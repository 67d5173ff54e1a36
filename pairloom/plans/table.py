"""The whole table of pair features.

Every distinct item's texts, vectors and lists are prepared once and joined to
the pairs; all features are then made in one pass over the pairs, the string
similarities of a batch of pairs at once.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import attrs as A
from pairloom.functions import edit as E
from pairloom.functions import lanes as L
from pairloom.functions import numbers as N
from pairloom.functions import retrieval as Q
from pairloom.functions import sets as S
from pairloom.functions import text as T
from pairloom.functions.units import find_units
from pairloom.operators import attribute_idf as I
from pairloom.operators.antiwords import anti_word_score, anti_words
from pairloom.operators.skew import hot_keys, repeat_rows, salted_lookup, spread_rows
from pairloom.operators.tfidf import distinct_texts, text_id, text_vectors, vector_cosine
from pairloom.plans.attributes import CUTS, JS, TOP
from pairloom.plans.base import Registry, pairs
from pairloom.scratch import Scratch

R = Registry()
C = F.col
CATS = [f"category_level_{k}" for k in (1, 2, 3, 4)]
FULL = ("name", "name_norm", "name_en", "name_mix", "description_en", "description_mix", "name_digits", "description_digits")
SHORT = ("description", "description_norm")
SETS = ("name", "name_en", "name_mix", "name_digits", "description", "description_en", "description_mix", "description_digits")
LISTS = ("attr_keys", "attr_vals", "units_name", "units_desc", "brands_name", "brands_desc")
RATIOS = ("price", "n_images", "attr_keys_len", "attr_vals_len", *[f"{t}_len" for t in ("name", "name_en", "name_mix", "name_norm", "description", "description_en", "description_mix", "description_norm")])
DIFFS = ("price", "n_images", "attr_keys_len", "attr_vals_len")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prepared_items(df: DataFrame, brands: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct item with its text variants, lists and lengths."""
    cols = ["variantid", "name", "description", *CATS, JS, "concat_keyval", "n_images", "price"]
    sides = [df.select(*[C(f"{c}_{k}").alias(c) for c in cols]) for k in (1, 2)]
    # a stated number of partitions: rows are few bytes but much work, so they are not to be coalesced by size
    it = sides[0].unionByName(sides[1]).repartition(_parts(df), "variantid").groupBy("variantid").agg(F.min(F.struct(*cols[1:])).alias("f")).select("variantid", "f.*")
    made: dict = {}
    for n in ("name", "description"):
        v = T.name_variants(n, "v")
        made |= {f"{n}_norm": v["v_norm"], f"{n}_en": v["v_en"], f"{n}_mix": v["v_mix"], f"t_{n}": v["v"], f"{n}_digits": T.digit_tokens(T.lowered(T.clean_html_emoji(n)))}
        made[f"units_{'name' if n == 'name' else 'desc'}"] = find_units(C(n))
    # staged, so that what follows reads columns instead of repeating their expressions
    it = scratch.save(it.withColumns(made)).withColumns({"name": C("t_name"), "description": C("t_description"), "kv": A.keys_and_values(JS), "flat": A.flat_entries(JS)}).drop("t_name", "t_description")
    # a word list of a few hundred rows
    words = brands.select(F.lower(F.trim("brand")).alias("w")).where("w <> ''").agg(F.collect_set("w").alias("l")).scalar()
    it = it.withColumns({"lexicon": words, "attr_keys": C("kv.keys"), "attr_vals": C("kv.vals"), "m": F.map_from_entries("flat")})
    it = it.withColumns({"brands_name": F.array_intersect(T.split_blank("name"), "lexicon"), "brands_desc": F.array_intersect(T.split_blank("description"), "lexicon")})
    lens = {f"{t}_len": T.token_length(t) for t in (x[:-4] for x in RATIOS if x.endswith("_len") and not x.startswith("attr"))}
    return it.withColumns({**lens, "attr_keys_len": F.size("attr_keys"), "attr_vals_len": F.size("attr_vals")}).drop("kv", "lexicon", JS)


def _by_word(c):
    return F.filter(T.words(F.lower(c)), lambda w: F.length(w) >= 2)


TERMS = {"name": _by_word, "description": _by_word, "concat_keyval": lambda c: T.split_blank(F.lower(c))}


def with_vectors(items: DataFrame, scratch: Scratch) -> DataFrame:
    """The items with the TF-IDF weights of their name, description and attributes: one for each distinct term, in their order."""
    out = items
    for c, toks in TERMS.items():
        vec = text_vectors(distinct_texts(items, [c]), toks, scratch)
        # many items may have the same text
        own = salted_lookup(items.select("variantid", text_id(c).alias("tid")), vec, ["tid"], C("variantid"))
        out = out.join(own.select("variantid", C("v").alias(f"v_{c}"), C("norm").alias(f"n_{c}")), "variantid", "left")
    weights = lambda c, toks: F.transform(F.array_distinct(toks(C(c))), lambda t: F.element_at(f"v_{c}", t))
    return out.select("*", *[weights(c, toks).alias(f"w_{c}") for c, toks in TERMS.items()]).drop(*[f"v_{c}" for c in TERMS])


def _free_shuffles(spark) -> None:
    """Lets go of the files of shuffles that no frame needs any more, as their results are staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def feature_table(spark, df: DataFrame, brands: DataFrame) -> DataFrame:
    """One row per distinct pair with all 444 features.

    What belongs to items is made once for each of them and staged; pairs are
    joined to their two items and every feature is an expression over that row,
    so no family of features is written or joined by itself.
    """
    scratch = Scratch(spark, "features")
    first = Scratch(spark, "items")
    items = scratch.save(prepared_items(df, brands, first))
    first.clear()
    keys = scratch.save(df.select("variantid_1", "variantid_2").distinct())
    idf = scratch.save(I.attribute_idf_levels(items.withColumnRenamed("flat", "e"), CATS, "e", scratch))
    # what a pair's row can be given from its other columns is not carried through the joins
    full = scratch.save(with_vectors(items.drop("flat", "name_norm", "description_norm"), scratch))
    scratch.drop(items)
    _free_shuffles(spark)
    side = lambda k: full.select(*[C(c).alias(f"{c}_{k}") for c in full.columns])
    # an item may stand in very many pairs
    left = salted_lookup(keys, side(1), ["variantid_1"], C("variantid_2"))
    hot = hot_keys(keys, ["variantid_2"])
    # a stated number of partitions: rows are few bytes but much work, so they are not to be coalesced by size
    left = spread_rows(left, hot, ["variantid_2"], C("variantid_1")).repartition(_parts(df), "variantid_2", "__salt")
    p = left.join(repeat_rows(side(2), hot, ["variantid_2"]), ["variantid_2", "__salt"])
    p = p.withColumns({f"{c}_norm_{k}": T.normalize_underscore(f"{c}_{k}") for c in ("name", "description") for k in (1, 2)})
    both = lambda c: (C(f"{c}_1"), C(f"{c}_2"))
    out: dict = {}

    for c in RATIOS:
        out[f"{c}_ratio_left"], out[f"{c}_ratio_right"] = N.ratios(*both(c))
    for c in ("name", "description"):
        out[f"{c}_words_left"], out[f"{c}_words_right"] = N.word_count_ratios(*both(c))
    for c in DIFFS:
        out[f"{c}_abs_diff"], out[f"{c}_sq_diff"] = N.abs_diff(*both(c)), N.sq_diff(*both(c))
    for c in ("category_level_3", "category_level_4", "n_images"):
        out[f"{c}_fillness"] = N.fillness(*both(c))
    same = [F.lower(f"{c}_1") == F.lower(f"{c}_2") for c in CATS]
    for k, s in enumerate(same, 1):
        out[f"category_{k}_match"] = s
    out["category_matches"] = sum((F.coalesce(s, F.lit(False)).cast("int") for s in same[1:]), F.coalesce(same[0], F.lit(False)).cast("int"))
    out["category_4_token_sort"] = E.token_sort_udf(*[F.coalesce(f"category_level_4_{k}", F.lit("None")) for k in (1, 2)])

    made: dict = {"strings": L.strings_udf(FULL, SHORT, 7)(*[x for c in (*FULL, *SHORT) for x in both(c)])}
    for c in (*FULL, *SHORT):
        for m in ("token_sort", "token_set", "jaro_winkler", "dice", *(("tanimoto", "sorensen", "damerau", "wratio") if c in FULL else ())):
            out[f"{c}_{m}"] = F.log2(f"strings.{c}_jaccard") if m == "tanimoto" else C(f"strings.{c}_{m}")
    out |= {"name_norm_prefix": S.common_prefix(*both("name_norm")), "name_norm_subsequence": C("strings.name_norm_subsequence")}

    none = F.array().cast("array<string>")
    for c in (*SETS, *LISTS):
        made |= {f"set_{c}_{k}": F.array_distinct(F.coalesce(x if c in LISTS else T.split_blank(x), none)) for k, x in enumerate(both(c), 1)}
        a, b = both(f"set_{c}")
        out |= {f"{c}_jaccard": S.jaccard(a, b), f"{c}_overlap": S.overlap(a, b)}
    for c in ("attr_keys", "attr_vals"):
        out[f"{c}_common"] = S.common(*both(c))
    out["attrs_equal"] = A.fully_equal_share(*both("m"))

    out |= {f"{c}_iou_{n}": C(f"strings.{c}_iou_{n}") for c in FULL for n in range(1, 8)}

    top = anti_words(df.where("is_double = 0"), "name_1", "name_2").agg(F.collect_list("word").alias("l"))
    # one row
    p = p.crossJoin(F.broadcast(scratch.save(top)))
    out["anti_words"] = anti_word_score(C("name_1"), C("name_2"), C("l"))

    text = lambda k: F.concat(F.lit("Name: "), F.coalesce(f"name_{k}", F.lit("")), F.lit(", Desc: "), F.coalesce(f"description_{k}", F.lit("")))
    for n, toks in (("name", lambda k: T.words(F.lower(f"name_{k}"))), ("name_desc", lambda k: T.words(F.lower(text(k)))), ("keyval", lambda k: T.split_blank(F.lower(f"concat_keyval_{k}")))):
        # columns of their own, so that no token list is made again for every token
        made |= {f"q_{n}_{k}": toks(k) for k in (1, 2)}
        out |= {f"bm25_{n}_left": Q.bm25_single(C(f"q_{n}_1"), C(f"q_{n}_2")), f"bm25_{n}_right": Q.bm25_single(C(f"q_{n}_2"), C(f"q_{n}_1"))}

    for c, toks in TERMS.items():
        a, b = both(c)
        made |= {f"v_{c}_{k}": F.map_from_arrays(F.array_distinct(toks(x)), C(f"w_{c}_{k}")) for k, x in ((1, a), (2, b))}
        out[f"{c}_tfidf"] = F.when(a.isNotNull() & b.isNotNull(), vector_cosine(*[x for k in (1, 2) for x in (C(f"v_{c}_{k}"), C(f"n_{c}_{k}"))]))

    made["equal"] = I.equal_keys(C("m_1"), C("m_2"))
    hits: dict = {}
    for level, cat in enumerate(CATS, 1):
        cuts = CUTS[level]
        ranked = I.ranked_keys(idf.where(C("level") == level), "category", max(cuts))
        ranked = scratch.save(ranked.select(C("category").alias(f"{cat}_1"), C("top").alias(f"top_{level}"), I.cut_weights(C("top"), cuts).alias(f"weights_{level}")))
        # one row per category
        p = p.join(F.broadcast(ranked), f"{cat}_1", "left")
        hits[f"hits_{level}"] = I.ranked_hits(C("equal"), C(f"{cat}_1") == C(f"{cat}_2"), C(f"top_{level}"))
        hits[f"places_{level}"] = F.transform(C(f"hits_{level}"), lambda e: e["rk"])
        out |= {f"top_{i}_attr_match_lvl{level}": F.coalesce(F.array_contains(f"places_{level}", i).cast("int"), F.lit(0)) for i in range(1, TOP[level] + 1)}
        most = F.lit(TOP[level])
        # no category, no size
        out[f"top_attr_matches_lvl{level}"] = F.when(C(f"places_{level}").isNotNull(), F.size(F.filter(f"places_{level}", lambda i: i <= most))).otherwise(F.lit(0))  # noqa: B023
        out |= {f"weighted_{n}_attr_match_lvl{level}": I.hit_share(C(f"hits_{level}"), C(f"weights_{level}"), place, n) for place, n in enumerate(cuts)}
    p = p.withColumns(made)
    p = p.withColumns({k: v for k, v in hits.items() if k.startswith("hits")}).withColumns({k: v for k, v in hits.items() if k.startswith("places")})
    return p.select("variantid_1", "variantid_2", *[v.alias(k) for k, v in out.items()])


@R.add()
def pair_features(spark, d):
    from pairloom.sources.tables import table

    return feature_table(spark, pairs(spark, d), table(spark, d, "brands"))
