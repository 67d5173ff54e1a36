"""Queries: pair features of numbers, sets, strings, lexicons and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pairloom.functions import attrs as A
from pairloom.functions import edit as E
from pairloom.functions import numbers as N
from pairloom.functions import retrieval as Q
from pairloom.functions import sets as S
from pairloom.functions import text as T
from pairloom.functions.units import UNITS, find_units
from pairloom.operators.antiwords import anti_word_score, anti_words
from pairloom.operators.tfidf import distinct_texts, idf_table, tfidf_cosine
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.plans.attributes import JS, S_LISTS, attr_lists
from pairloom.plans.texts import S_BLANK, S_WORDS, _s_digits, _sql, s_clean, s_latin, s_lowered, s_mixed, s_norm, s_squeeze
from pairloom.scratch import Scratch
from pairloom.sources.tables import table

R = Registry()
C = F.col


def _s_intersect(a, b):
    """Distinct shared elements in SQL."""
    return f"list_distinct(list_filter({a}, lambda e: list_contains({b}, e)))"


def spread(spark, d, *cols):
    """The named columns in as many partitions as shuffles have: few bytes, but much work a row."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs(spark, d).select(*IDS, *cols).repartition(n, *IDS)


# the text variants that features compare, with their SQL

FULL = ("name", "name_norm", "name_en", "name_mix", "description_en", "description_mix", "name_digits", "description_digits")
BLANK_SETS = ("name", "name_en", "name_mix", "name_digits", "description", "description_en", "description_mix", "description_digits")
LENGTHS = ("name", "name_en", "name_mix", "name_norm", "description", "description_en", "description_mix", "description_norm")


def _variant(v, k):
    col, _, kind = v.partition("_")
    col = f"{col}_{k}"
    if kind == "digits":
        return T.digit_tokens(T.lowered(T.clean_html_emoji(col)))
    made = T.name_variants(col, "v")
    return made["v_norm" if kind == "norm" else f"v_{kind}" if kind else "v"]


def _s_variant(v, k):
    col, _, kind = v.partition("_")
    col = f"{col}_{k}"
    return {
        "": s_squeeze(s_lowered(s_clean(col))),
        "norm": s_norm(s_clean(col)),
        "en": s_squeeze(s_lowered(s_clean(s_latin(col)))),
        "mix": s_squeeze(s_lowered(s_mixed(col))),
        "digits": _s_digits(s_lowered(s_clean(col))),
    }[kind]


def variants(spark, d, names):
    """Pairs with the named variants of both sides, staged.

    The texts are spread over as many partitions as shuffles have, since a row
    is few bytes but much work; the stage keeps the regular expressions out of
    what is built on them.
    """
    cols = sorted({f"{v.partition('_')[0]}_{k}" for v in names for k in (1, 2)})
    return Scratch(spark, "variants").save(spread(spark, d, *cols).select(*IDS, *[_variant(v, k).alias(f"{v}_{k}") for v in names for k in (1, 2)]))


def _s_variants(names):
    return "v AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{_s_variant(v, k)} AS {v}_{k}" for v in names for k in (1, 2)) + " FROM train_df)"


def _over(names, one, s_one):
    """SQL and columns of one expression over both sides of each variant."""
    return f"WITH {_s_variants(names)} SELECT variantid_1, variantid_2, " + ", ".join(s_one(v) for v in names) + " FROM v", lambda spark, d: variants(spark, d, names).select(*IDS, *[c for v in names for c in one(v)])


def wide(name, doc, names, one, s_one):
    sql, run = _over(names, one, s_one)
    run.__name__, run.__doc__ = name, doc
    return R.add(sql)(run)


# numbers


def _s_ratio(a, i, j, out):
    return f"round({a}_{i}::DOUBLE / nullif({a}_{j}, 0), 6) AS {out}"


def _ratio_cols(a, left, right):
    one, two = N.ratios(left, right)
    return [r6(one).alias(f"{a}_left"), r6(two).alias(f"{a}_right")]


@R.add(_sql(", ".join(_s_ratio(a, i, j, f"{a}_{n}") for a in ("price", "n_images") for n, i, j in (("left", 1, 2), ("right", 2, 1)))))
def numeric_ratios(spark, d):
    return pairs(spark, d).select(*IDS, *[c for a in ("price", "n_images") for c in _ratio_cols(a, C(f"{a}_1"), C(f"{a}_2"))])


def _s_token_length(c):
    return f"(length({c}) - length(replace({c}, ' ', '')) + 1)"


wide(
    "length_ratios",
    "Ratios of the token counts of all text variants.",
    LENGTHS,
    lambda v: _ratio_cols(f"{v}_len", T.token_length(f"{v}_1"), T.token_length(f"{v}_2")),
    lambda v: ", ".join(f"round({_s_token_length(f'{v}_{i}')}::DOUBLE / nullif({_s_token_length(f'{v}_{j}')}, 0), 6) AS {v}_len_{n}" for n, i, j in (("left", 1, 2), ("right", 2, 1))),
)

_ATTR = ("attr_keys", "attr_vals")


@R.add(
    f"{S_LISTS} SELECT variantid_1, variantid_2, "
    + ", ".join(f"len({a}_{k})::INTEGER AS {a}_len_{k}" for a in _ATTR for k in (1, 2))
    + ", "
    + ", ".join(f"round(len({a}_{i})::DOUBLE / nullif(len({a}_{j}), 0), 6) AS {a}_{n}" for a in _ATTR for n, i, j in (("left", 1, 2), ("right", 2, 1)))
    + ", "
    + ", ".join(f"abs(len({a}_1) - len({a}_2))::BIGINT AS {a}_diff, ((len({a}_1) - len({a}_2)) * (len({a}_1) - len({a}_2)))::DECIMAL(20,0) AS {a}_sq" for a in _ATTR)
    + " FROM q"
)
def attr_length_features(spark, d):
    """Lengths of the attribute lists with their ratios and differences."""
    df = attr_lists(spark, d).select(*IDS, *[F.size(f"{a}_{k}").alias(f"{a}_len_{k}") for a in _ATTR for k in (1, 2)])
    cols = []
    for a in _ATTR:
        left, right = C(f"{a}_len_1"), C(f"{a}_len_2")
        cols += [*_ratio_cols(a, left, right), N.abs_diff(left, right).alias(f"{a}_diff"), N.sq_diff(left, right).alias(f"{a}_sq")]
    return df.select("*", *cols)


def _s_count(c):
    return f"coalesce(len({S_BLANK.format(c)}), 0)"


@R.add(_sql(", ".join(f"coalesce(round({_s_count(f'{a}_{i}')}::DOUBLE / nullif({_s_count(f'{a}_{j}')}, 0), 6), 0) AS {a}_{n}" for a in ("name", "description") for n, i, j in (("left", 1, 2), ("right", 2, 1)))))
def wordcount_ratios(spark, d):
    cols = []
    for a in ("name", "description"):
        left, right = N.word_count_ratios(C(f"{a}_1"), C(f"{a}_2"))
        cols += [r6(left).alias(f"{a}_left"), r6(right).alias(f"{a}_right")]
    return pairs(spark, d).select(*IDS, *cols)


@R.add(_sql("abs(trunc(price_1)::BIGINT - trunc(price_2)::BIGINT) AS price_diff, abs(n_images_1 - n_images_2)::BIGINT AS n_images_diff"))
def abs_diff(spark, d):
    return pairs(spark, d).select(*IDS, N.abs_diff(C("price_1"), C("price_2")).alias("price_diff"), N.abs_diff(C("n_images_1"), C("n_images_2")).alias("n_images_diff"))


@R.add(_sql("CASE WHEN price_1 + price_2 IS NOT NULL THEN least((trunc(price_1)::BIGINT::HUGEINT - trunc(price_2)::BIGINT) * (trunc(price_1)::BIGINT::HUGEINT - trunc(price_2)::BIGINT), 18446744073709551614) END::DECIMAL(20,0) AS price_sq, ((n_images_1 - n_images_2)::BIGINT * (n_images_1 - n_images_2))::DECIMAL(20,0) AS n_images_sq"))
def sq_diff(spark, d):
    return pairs(spark, d).select(*IDS, N.sq_diff(C("price_1"), C("price_2")).alias("price_sq"), N.sq_diff(C("n_images_1"), C("n_images_2")).alias("n_images_sq"))


def _s_fill(a):
    return f"CASE WHEN {a}_1 IS NOT NULL AND {a}_2 IS NOT NULL THEN 'both' WHEN {a}_1 IS NULL AND {a}_2 IS NULL THEN 'none' ELSE 'only one' END AS {a}_fill"


_FILL = ("category_level_3", "category_level_4", "n_images")


@R.add(_sql(", ".join(map(_s_fill, _FILL))))
def fillness(spark, d):
    return pairs(spark, d).select(*IDS, *[N.fillness(C(f"{a}_1"), C(f"{a}_2")).alias(f"{a}_fill") for a in _FILL])


_CATS = [f"category_level_{k}" for k in (1, 2, 3, 4)]


@R.add(_sql(", ".join(f"lower({c}_1) = lower({c}_2) AS match_{i}" for i, c in enumerate(_CATS, 1)) + ", (" + " + ".join(f"coalesce(lower({c}_1) = lower({c}_2), false)::INTEGER" for c in _CATS) + ")::INTEGER AS n_match"))
def category_match(spark, d):
    same = [F.lower(f"{c}_1") == F.lower(f"{c}_2") for c in _CATS]
    total = sum((F.coalesce(s, F.lit(False)).cast("int") for s in same[1:]), F.coalesce(same[0], F.lit(False)).cast("int"))
    return pairs(spark, d).select(*IDS, *[s.alias(f"match_{i}") for i, s in enumerate(same, 1)], total.alias("n_match"))


# sets


def _toks(c):
    """Distinct words of the underscored form."""
    return F.filter(F.split(T.normalize_underscore(F.coalesce(C(c), F.lit(""))), "_"), lambda w: w != "")


def _s_toks(c):
    norm = s_norm(f"coalesce({c}, '')")
    return f"list_distinct(list_filter(string_split({norm}, '_'), lambda w: w <> ''))"


def _s_set_sims(a, b, name):
    both, either = f"len({_s_intersect(a, b)})", f"len(list_distinct(list_concat({a}, {b})))"
    return f"coalesce(round({both}::DOUBLE / nullif({either}, 0), 6), 0) AS {name}_jaccard, coalesce(round({both}::DOUBLE / nullif(least(len({a}), len({b})), 0), 6), 0) AS {name}_overlap"


@R.add(_sql(", ".join(_s_set_sims(_s_toks(f"{n}_1"), _s_toks(f"{n}_2"), n) for n in ("name", "description"))))
def set_sim_tokens(spark, d):
    cols = []
    for n in ("name", "description"):
        a, b = F.array_distinct(_toks(f"{n}_1")), F.array_distinct(_toks(f"{n}_2"))
        cols += [r6(S.jaccard(a, b)).alias(f"{n}_jaccard"), r6(S.overlap(a, b)).alias(f"{n}_overlap")]
    return pairs(spark, d).select(*IDS, *cols)


def _s_or_empty(c):
    return f"coalesce({c}, '')"


def _s_low(c):
    return f"lower({_s_or_empty(c)})"


def _set_cols(v, a, b):
    return [r6(S.jaccard(a, b)).alias(f"{v}_jaccard"), r6(S.overlap(a, b)).alias(f"{v}_overlap")]


def _blank_set(c):
    return F.array_distinct(F.coalesce(T.split_blank(C(c)), F.array().cast("array<string>")))


def _kv(c):
    return _blank_set(c)


def _s_kv(c):
    return f"list_distinct({S_BLANK.format(_s_or_empty(c))})"


wide(
    "set_sim_variants",
    "Jaccard and overlap of the blank-separated words of all eight text variants.",
    BLANK_SETS,
    lambda v: _set_cols(v, _blank_set(f"{v}_1"), _blank_set(f"{v}_2")),
    lambda v: _s_set_sims(_s_kv(f"{v}_1"), _s_kv(f"{v}_2"), v),
)


def _words_of(spark, d, name, col):
    # word lists are fixed tables of a few hundred rows
    return _lexicon(spark, d, name, col).agg(F.array_sort(F.collect_set("w")).alias("l")).scalar()


def collections(spark, d):
    """Pairs with the collections of both sides: attribute keys and values, key-value words, brands of both texts."""
    texts = pairs(spark, d).select(*IDS, *[f"{n}_{k}" for n in ("name", "description", "concat_keyval", JS) for k in (1, 2)], _words_of(spark, d, "brands", "brand").alias("lexicon"))
    df = texts.withColumns({f"kv{k}": A.keys_and_values(f"{JS}_{k}") for k in (1, 2)})
    made = {}
    for k in (1, 2):
        made |= {f"attr_keys_{k}": C(f"kv{k}.keys"), f"attr_vals_{k}": C(f"kv{k}.vals"), f"keyval_{k}": _kv(f"concat_keyval_{k}")}
        made |= {f"brands_{n}_{k}": F.array_intersect(_blank_set_lower(f"{n}_{k}"), "lexicon") for n in ("name", "description")}
    return df.select(*IDS, *[c.alias(n) for n, c in made.items()])


def _blank_set_lower(c):
    return F.array_distinct(T.split_blank(F.lower(F.coalesce(C(c), F.lit("")))))


COLLECTIONS = ("attr_keys", "attr_vals", "keyval", "brands_name", "brands_description")
_S_COLLECTIONS = (
    f"{S_LISTS}, b AS (SELECT list(DISTINCT lower(trim(brand, ' '))) AS l FROM brands WHERE trim(brand, ' ') <> ''),"
    " t AS (SELECT row_number() OVER () AS rid, * FROM train_df), u AS (SELECT t.variantid_1, t.variantid_2, "
    + ", ".join(f"list_distinct(z{k}.keys) AS attr_keys_{k}, list_distinct(z{k}.vals) AS attr_vals_{k}, {_s_kv(f'concat_keyval_{k}')} AS keyval_{k}" for k in (1, 2))
    + ", "
    + ", ".join(f"list_filter(list_distinct({S_BLANK.format(_s_low(f'{n}_{k}'))}), lambda w: list_contains(b.l, w)) AS brands_{n}_{k}" for n in ("name", "description") for k in (1, 2))
    + f" FROM t, b, {', '.join(f'q1 z{k}' for k in (1, 2))} WHERE z1.j IS NOT DISTINCT FROM {JS}_1 AND z2.j IS NOT DISTINCT FROM {JS}_2)"
)


@R.add(f"{_S_COLLECTIONS} SELECT variantid_1, variantid_2, " + ", ".join(_s_set_sims(f"{c}_1", f"{c}_2", c) for c in COLLECTIONS) + " FROM u")
def set_sim_collections(spark, d):
    """Jaccard and overlap of attribute keys, attribute values, key-value words and brands."""
    return collections(spark, d).select(*IDS, *[x for c in COLLECTIONS for x in _set_cols(c, C(f"{c}_1"), C(f"{c}_2"))])


@R.add(f"{_S_COLLECTIONS} SELECT variantid_1, variantid_2, " + ", ".join(f"len({_s_intersect(f'{c}_1', f'{c}_2')})::INTEGER AS {c}_common" for c in COLLECTIONS) + " FROM u")
def common_count(spark, d):
    return collections(spark, d).select(*IDS, *[S.common(C(f"{c}_1"), C(f"{c}_2")).alias(f"{c}_common") for c in COLLECTIONS])


def _s_grams(c, n):
    t = f"lower(coalesce({c}, ''))"
    return f"list_distinct(list_transform(range(1, length({t}) - {n} + 2), lambda i: substring({t}, i, {n})))"


_NGRAMS = range(1, 8)


def _s_gram_lists():
    return "g AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{_s_grams(f'{v}_{k}', n)} AS {v}_{n}_{k}" for v in FULL for n in _NGRAMS for k in (1, 2)) + " FROM v)"


def _s_iou(v, n):
    a, b = f"{v}_{n}_1", f"{v}_{n}_2"
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce(round({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 6), 0) AS {v}_iou_{n}"


@R.add(f"WITH {_s_variants(FULL)}, {_s_gram_lists()} SELECT variantid_1, variantid_2, " + ", ".join(_s_iou(v, n) for v in FULL for n in _NGRAMS) + " FROM g")
def ngram_iou(spark, d):
    """Character n-gram overlap of eight text variants for n = 1..7."""
    cols = [r6(S.ngram_iou(T.char_ngrams(f"{v}_1", n), T.char_ngrams(f"{v}_2", n))).alias(f"{v}_iou_{n}") for v in FULL for n in _NGRAMS]
    return variants(spark, d, FULL).select(*IDS, *cols)


# strings


def _s_shared(a, b):
    la, lb = f"list_filter(string_split({a}, ''), lambda x: x <> '')", f"list_filter(string_split({b}, ''), lambda x: x <> '')"
    return f"coalesce(list_sum(list_transform({_s_intersect(la, lb)}, lambda x: least(len(list_filter({la}, lambda y: y = x)), len(list_filter({lb}, lambda y: y = x))))), 0)"


def _s_multiset(v):
    a, b = f"{v}_1", f"{v}_2"
    sh = _s_shared(a, b)
    return (
        f"round(CASE WHEN {a} = {b} THEN 1 ELSE 2.0::DOUBLE * {sh} / (length({a}) + length({b})) END, 6) AS {v}_dice,"
        f" round(CASE WHEN {a} = {b} THEN 0 WHEN {sh} > 0 THEN log2({sh}::DOUBLE / (length({a}) + length({b}) - {sh})) END, 6) AS {v}_tanimoto"
    )


wide(
    "char_multiset_sim",
    "Dice (the same as Sørensen) and Tanimoto of the characters of eight text variants.",
    FULL,
    lambda v: [r6(S.dice(C(f"{v}_1"), C(f"{v}_2"))).alias(f"{v}_dice"), r6(S.tanimoto(C(f"{v}_1"), C(f"{v}_2"))).alias(f"{v}_tanimoto")],
    _s_multiset,
)

# One ASCII sign for each other letter and sign of the tables, since the SQL functions compare bytes.
_FOLD_FROM = "абвгдежзийклмнопрстуфхцчшщъыьэюяё·✅🔥🎁⚡"
_FOLD_TO = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || " + " || ".join(f"chr({k})" for k in (1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17))


def _s_fold(c):
    return f"translate({c}, '{_FOLD_FROM}', {_FOLD_TO})"


wide(
    "string_sim_core",
    "Jaro-Winkler of eight text variants.",
    FULL,
    lambda v: [r6(E.jaro_winkler_udf(C(f"{v}_1"), C(f"{v}_2"))).alias(f"{v}_jaro_winkler")],
    lambda v: f"round(jaro_winkler_similarity({_s_fold(f'{v}_1')}, {_s_fold(f'{v}_2')}), 6) AS {v}_jaro_winkler",
)


def _s_lcs(a, b):
    """Length of the longest common subsequence of two lists: one row of the table after the other."""
    rows = f"list_concat([list_transform(range(len({b}) + 1), lambda z: 0)], list_transform({a}, lambda x: list_concat([-1], list_transform({b}, lambda y: (y = x)::INTEGER))))"
    row = "list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: CASE WHEN e[q] = 1 THEN r[q - 1] + 1 ELSE r[q] END)))"
    return f"list_last(list_reduce({rows}, lambda r, e: {row}))"


def _s_letters(c):
    return f"list_filter(string_split({c}, ''), lambda x: x <> '')"


def _s_ratio_of(a, b):
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1 ELSE 2.0::DOUBLE * {_s_lcs(_s_letters(a), _s_letters(b))} / (length({a}) + length({b})) END"


_S_TOKENS = """t AS (SELECT variantid_1, variantid_2, name_1, name_2, {0} AS a, {1} AS b FROM train_df),
    k AS (SELECT *, array_to_string(list_sort(a), ' ') AS sa, array_to_string(list_sort(b), ' ') AS sb,
        array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), ' ') AS shr,
        array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS ra,
        array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS rb FROM t),
    w AS (SELECT *, trim(shr || ' ' || ra, ' ') AS wa, trim(shr || ' ' || rb, ' ') AS wb FROM k)""".format(*(S_BLANK.format(f"name_{k}") for k in (1, 2)))


@R.add(
    f"""WITH {_S_TOKENS} SELECT variantid_1, variantid_2, round({_s_ratio_of('sa', 'sb')}, 6) AS token_sort,
    round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN a IS NULL OR b IS NULL THEN NULL WHEN shr <> '' AND (ra = '' OR rb = '') THEN 1
        ELSE greatest({_s_ratio_of('wa', 'wb')}, CASE WHEN shr <> '' THEN greatest(2.0::DOUBLE * length(shr) / (length(shr) + length(wa)), 2.0::DOUBLE * length(shr) / (length(shr) + length(wb))) ELSE 0 END) END, 6) AS token_set FROM w"""
)
def token_ratios(spark, d):
    """Token-sort and token-set ratios of the names."""
    a, b = C("name_1"), C("name_2")
    return spread(spark, d, "name_1", "name_2").select(*IDS, r6(E.token_sort_udf(a, b)).alias("token_sort"), r6(E.token_set_udf(a, b)).alias("token_set"))


@R.add()
def wratio(spark, d):
    return spread(spark, d, "name_1", "name_2").select(*IDS, E.weighted_udf(C("name_1"), C("name_2")).alias("wratio"))


wide(
    "edit_distance",
    "Damerau-Levenshtein distance of eight text variants.",
    FULL,
    lambda v: [E.damerau_levenshtein_udf(C(f"{v}_1"), C(f"{v}_2")).alias(f"{v}_distance")],
    lambda v: f"damerau_levenshtein({_s_fold(f'{v}_1')}, {_s_fold(f'{v}_2')})::DOUBLE AS {v}_distance",
)


def _s_lcp(a, b):
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE round(len(list_filter(range(1, {n} + 1), lambda i: substring({a}, 1, i) = substring({b}, 1, i)))::DOUBLE / {n}, 6) END"


@R.add(_sql(f"{_s_lcp(s_norm('name_1'), s_norm('name_2'))} AS prefix"))
def common_prefix(spark, d):
    return spread(spark, d, "name_1", "name_2").select(*IDS, r6(S.common_prefix(T.normalize_underscore("name_1"), T.normalize_underscore("name_2"))).alias("prefix"))


@R.add(
    f"""WITH n AS (SELECT variantid_1, variantid_2, {s_norm('name_1')} AS a, {s_norm('name_2')} AS b FROM train_df)
    SELECT variantid_1, variantid_2, {_s_lcp('a', 'b')} AS prefix, round(coalesce({_s_lcs(_s_letters('a'), _s_letters('b'))}::DOUBLE / nullif(greatest(length(a), length(b)), 0), 0), 6) AS subsequence FROM n"""
)
def lcp_lcs(spark, d):
    """Common prefix and common subsequence of the underscored names."""
    a, b = T.normalize_underscore("name_1"), T.normalize_underscore("name_2")
    return spread(spark, d, "name_1", "name_2").select(*IDS, r6(S.common_prefix(a, b)).alias("prefix"), r6(E.lcs_share_udf(a, b)).alias("subsequence"))


# lexicons and units


def _lexicon(spark, d, name, col):
    return table(spark, d, name).select(F.lower(F.trim(col)).alias("w")).where("w <> ''").distinct()


_LEX_TEXTS = [f"{n}_{k}" for n in ("name", "description") for k in (1, 2)]


@R.add(
    """WITH b AS (SELECT list(DISTINCT lower(trim(brand, ' '))) AS l FROM brands WHERE trim(brand, ' ') <> ''),
    c AS (SELECT list(DISTINCT lower(trim(word_0, ' '))) AS l FROM colors WHERE trim(word_0, ' ') <> '')
    SELECT variantid_1, variantid_2, """
    + ", ".join(f"""array_to_string(list_sort(list_filter(list_distinct({S_BLANK.format(_s_low(t))}), lambda x: list_contains({k}.l, x))), ' ') AS {n}_{t}""" for n, k in (("brands", "b"), ("colors", "c")) for t in _LEX_TEXTS)
    + " FROM train_df, b, c"
)
def lexicon_match(spark, d):
    """Distinct words of names and descriptions that the brand and colour lists hold."""
    found = [_words_of(spark, d, name, col).alias(f"l_{name}") for name, col in (("brands", "brand"), ("colors", "word_0"))]
    df = pairs(spark, d).select(*IDS, *[_blank_set_lower(t).alias(t) for t in _LEX_TEXTS], *found)
    return df.select(*IDS, *[F.array_join(F.sort_array(F.array_intersect(t, f"l_{n}")), " ").alias(f"{n}_{t}") for n in ("brands", "colors") for t in _LEX_TEXTS])


@R.add(
    _sql(
        ", ".join(
            f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({t}, ''), '[0-9]+\\s*[xх*]\\s*[0-9]+(?:\\s*[xх*]\\s*[0-9]+)?'),"
            f" lambda m: regexp_replace(m, '\\s*[xх*]\\s*', 'x', 'g')))), ' ') AS dims_{t}"
            for t in _LEX_TEXTS
        )
    )
)
def extract_dimensions(spark, d):
    """``AxB`` and ``AxBxC`` dimensions of names and descriptions."""
    return pairs(spark, d).select(*IDS, *[F.array_join(F.filter(find_units(C(t)), lambda m: m.rlike("^[0-9]+x[0-9x]+$")), " ").alias(f"dims_{t}") for t in _LEX_TEXTS])


def _s_units(t):
    """``find_units`` in SQL: a unit's border takes the sign behind it along, since there is no look-around."""
    c, made = f"coalesce({t}, '')", []
    ends = {True: "(?:[^\\p{L}\\p{N}_]|$)", False: "[\\p{L}\\p{N}_]"}
    for is_word, behind in ends.items():
        own = sorted((u for u in UNITS if (u[-1].isalnum() or u[-1] == "_") == is_word), key=lambda u: (-len(u), u))
        p = f"(?i)([0-9]+(?:[.,][0-9]+)?)\\s?({'|'.join(re.escape(u) for u in own)}){behind}".replace("\\ ", " ")
        made.append(f"list_transform(list_zip(regexp_extract_all({c}, '{p}', 1), regexp_extract_all({c}, '{p}', 2)), lambda z: z[1] || ' ' || z[2])")
    dims = f"list_transform(regexp_extract_all({c}, '[0-9]+\\s*[xх*]\\s*[0-9]+(?:\\s*[xх*]\\s*[0-9]+)?'), lambda m: regexp_replace(m, '\\s*[xх*]\\s*', 'x', 'g'))"
    return f"list_sort(list_distinct(list_concat({made[0]}, {made[1]}, {dims}))) AS units_{t}"


@R.add(_sql(", ".join(map(_s_units, _LEX_TEXTS))))
def extract_units(spark, d):
    """Numbers with units and dimensions of names and descriptions."""
    return pairs(spark, d).select(*IDS, *[find_units(C(t)).alias(f"units_{t}") for t in _LEX_TEXTS])


_S_RUNS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+'))"
_S_XOR = f"list_concat(list_filter({_S_RUNS.format('name_1')}, lambda x: NOT list_contains({_S_RUNS.format('name_2')}, x)), list_filter({_S_RUNS.format('name_2')}, lambda x: NOT list_contains({_S_RUNS.format('name_1')}, x)))"
_S_ANTI = f"SELECT word, count(*) AS n FROM (SELECT unnest({_S_XOR}) AS word FROM train_df WHERE is_double = 0) WHERE length(word) > 2 GROUP BY 1 ORDER BY n DESC, word LIMIT 100"


@R.add(_S_ANTI)
def anti_words_top(spark, d):
    return anti_words(pairs(spark, d).where("is_double = 0"), "name_1", "name_2")


@R.add(
    f"""WITH t AS (SELECT list(word) AS l FROM ({_S_ANTI})) SELECT variantid_1, variantid_2,
    coalesce(round(len(list_filter({_S_XOR}, lambda x: list_contains(t.l, x)))::DOUBLE / nullif(greatest(len({_S_RUNS.format('name_1')}), len({_S_RUNS.format('name_2')})), 0), 6), 0) AS score FROM train_df, t"""
)
def anti_words_score(spark, d):
    df = pairs(spark, d)
    # the list has at most 100 words
    top = anti_words(df.where("is_double = 0"), "name_1", "name_2").agg(F.collect_list("word").alias("l")).scalar()
    return df.select(*IDS, r6(anti_word_score(C("name_1"), C("name_2"), top)).alias("score"))


# retrieval


def _s_bm25(q, doc):
    f = f"len(list_filter({doc}, lambda y: y = x))"
    return f"CASE WHEN len({q}) > 0 AND len({doc}) > 0 THEN round(coalesce(list_sum(list_transform({q}, lambda x: 0.25::DOUBLE * ln(1.0 / 3) * 2.5 * {f} / ({f} + 1.5))), 0), 6) END"


def _bm25_query(doc_name, tokens, s_tokens):
    a, b = s_tokens(1), s_tokens(2)

    def run(spark, d):
        t1, t2 = tokens(1), tokens(2)
        df = spread(spark, d, "name_1", "name_2", "description_1", "description_2", "concat_keyval_1", "concat_keyval_2").select(*IDS, t1.alias("t1"), t2.alias("t2"))
        return df.select(*IDS, r6(Q.bm25_single(C("t1"), C("t2"))).alias("bm25_left"), r6(Q.bm25_single(C("t2"), C("t1"))).alias("bm25_right"))

    run.__name__ = doc_name
    return R.add(f"WITH t AS (SELECT variantid_1, variantid_2, {a} AS t1, {b} AS t2 FROM train_df) SELECT variantid_1, variantid_2, {_s_bm25('t1', 't2')} AS bm25_left, {_s_bm25('t2', 't1')} AS bm25_right FROM t")(run)


bm25_name = _bm25_query("bm25_name", lambda k: T.words(F.lower(f"name_{k}")), lambda k: S_WORDS.format(f"lower(name_{k})"))
bm25_name_desc = _bm25_query(
    "bm25_name_desc",
    lambda k: T.words(F.lower(F.concat(F.lit("Name: "), F.coalesce(f"name_{k}", F.lit("")), F.lit(", Desc: "), F.coalesce(f"description_{k}", F.lit(""))))),
    lambda k: S_WORDS.format(f"lower('Name: ' || coalesce(name_{k}, '') || ', Desc: ' || coalesce(description_{k}, ''))"),
)
bm25_keyval = _bm25_query("bm25_keyval", lambda k: T.split_blank(F.lower(f"concat_keyval_{k}")), lambda k: S_BLANK.format(f"lower(concat_keyval_{k})"))


def _tf_tokens(c):
    return F.filter(T.words(F.lower(c)), lambda w: F.length(w) >= 2)


_S_TF = "list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"
_S_TEXTS = "t AS (SELECT DISTINCT t FROM (SELECT name_1 AS t FROM train_df UNION ALL SELECT name_2 FROM train_df) WHERE t IS NOT NULL)"
_S_IDF = f"d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_S_TF})) AS term FROM t) GROUP BY 1), i AS (SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1 + df)) + 1 AS idf FROM d)"


@R.add(f"WITH {_S_TEXTS}, {_S_IDF} SELECT term, df, round(idf, 6) AS idf FROM i")
def tfidf_idf_table(spark, d):
    texts = distinct_texts(pairs(spark, d), ["name_1", "name_2"])
    return idf_table(texts, _tf_tokens(C("text"))).select("term", "df", r6(C("idf")).alias("idf"))


_S_TF_OF = {"name": _S_TF, "description": _S_TF, "concat_keyval": S_BLANK.format("lower(t)")}


def _cosine_query(name, col):
    tf, a, b = _S_TF_OF[col], f"{col}_1", f"{col}_2"
    tokens = (lambda c: T.split_blank(F.lower(c))) if col == "concat_keyval" else _tf_tokens

    def run(spark, d):
        out = tfidf_cosine(pairs(spark, d), a, b, tokens)
        return out.select(a, b, r6(C("cosine")).alias("cosine"))

    run.__name__ = name
    return R.add(
        f"""WITH t AS (SELECT DISTINCT t FROM (SELECT {a} AS t FROM train_df UNION ALL SELECT {b} FROM train_df) WHERE t IS NOT NULL), {_S_IDF.replace(_S_TF, tf)},
    w AS (SELECT t, term, count(*) * any_value(idf) AS w FROM (SELECT t, unnest({tf}) AS term FROM t) JOIN i USING (term) GROUP BY 1, 2),
    n AS (SELECT t, sqrt(sum(w * w)) AS n FROM w GROUP BY 1), p AS (SELECT DISTINCT {a} AS a, {b} AS b FROM train_df WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    s AS (SELECT p.a, p.b, sum(x.w * y.w) AS dot FROM p JOIN w x ON x.t = p.a JOIN w y ON y.t = p.b AND y.term = x.term GROUP BY 1, 2)
    SELECT p.a AS {a}, p.b AS {b}, coalesce(round(dot / (na.n * nb.n), 6), 0) AS cosine
    FROM p LEFT JOIN s USING (a, b) LEFT JOIN n na ON na.t = p.a LEFT JOIN n nb ON nb.t = p.b"""
    )(run)


tfidf_cosine_names = _cosine_query("tfidf_cosine_names", "name")
tfidf_cosine_descriptions = _cosine_query("tfidf_cosine_descriptions", "description")
tfidf_cosine_keyval = _cosine_query("tfidf_cosine_keyval", "concat_keyval")


_S_WORDS_OF = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_ROUGE = {"name": lambda k: F.coalesce(f"name_{k}", F.lit("")), "text": lambda k: F.concat(F.coalesce(f"name_{k}", F.lit("")), F.lit(" "), F.coalesce(f"description_{k}", F.lit("")))}
_S_ROUGE = {"name": lambda k: f"coalesce(name_{k}, '')", "text": lambda k: f"coalesce(name_{k}, '') || ' ' || coalesce(description_{k}, '')"}
_S_ROUGE_WORDS = "t AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{_S_WORDS_OF.format(_S_ROUGE[x](k))} AS {x}_{k}" for x in _ROUGE for k in (1, 2)) + " FROM train_df)"


def rouge_words(spark, d):
    """Words of the names, and of names with descriptions, of both sides."""
    df = spread(spark, d, *[f"{n}_{k}" for n in ("name", "description") for k in (1, 2)])
    return df.select(*IDS, *[T.words(F.lower(_ROUGE[x](k))).alias(f"{x}_{k}") for x in _ROUGE for k in (1, 2)])


def _s_ngram(n):
    return f"list_transform(range(1, len({{0}}) - {n} + 2), lambda i: array_to_string({{0}}[i:i + {n - 1}], ' '))"


def _s_prf(a, b, out):
    """Recall, precision and F of the multisets' overlap; ``a`` is the reference."""
    hit = f"coalesce(list_sum(list_transform({_s_intersect(a, b)}, lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"
    return ", ".join(f"coalesce(round({two}::DOUBLE * {hit} / nullif({n}, 0), 6), 0) AS {out}_{m}" for m, two, n in (("r", 1, f"len({a})"), ("p", 1, f"len({b})"), ("f", 2, f"(len({a}) + len({b}))")))


def _prf(hit, n_a, n_b, out):
    parts = (("r", hit * 1.0, n_a), ("p", hit * 1.0, n_b), ("f", hit * 2.0, n_a + n_b))
    return [r6(F.coalesce(F.try_divide(x, n), F.lit(0.0))).alias(f"{out}_{m}") for m, x, n in parts]


def _grams_frame(df, made):
    """``df`` with gram lists of both sides, staged as columns before they are compared."""
    return df.select(*IDS, *[c.alias(n) for n, c in made.items()])


_GRAMS = (1, 2, 3, 4)


@R.add(
    f"WITH {_S_ROUGE_WORDS}, g AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{_s_ngram(n).format(f'{x}_{k}')} AS {x}{n}_{k}" for x in _ROUGE for n in _GRAMS for k in (1, 2)) + " FROM t) SELECT variantid_1, variantid_2, "
    + ", ".join(_s_prf(f"{x}{n}_1", f"{x}{n}_2", f"{x}_rouge_{n}") for x in _ROUGE for n in _GRAMS)
    + " FROM g"
)
def rouge_n(spark, d):
    """ROUGE-1 to ROUGE-4 (recall, precision, F) of the names and of names with descriptions."""
    words = rouge_words(spark, d)
    df = words.select(*IDS, *[Q.token_ngrams(C(f"{x}_{k}"), n).alias(f"{x}{n}_{k}") for x in _ROUGE for n in _GRAMS for k in (1, 2)])
    return df.select(*IDS, *[c for x in _ROUGE for n in _GRAMS for c in _prf(E.shared_items_udf(C(f"{x}{n}_1"), C(f"{x}{n}_2")), F.size(f"{x}{n}_1"), F.size(f"{x}{n}_2"), f"{x}_rouge_{n}")])


def _s_lcs_prf(x):
    hit = _s_lcs(f"{x}_1", f"{x}_2")
    return ", ".join(f"coalesce(round({two}::DOUBLE * h_{x} / nullif({n}, 0), 6), 0) AS {x}_rouge_l_{m}" for m, two, n in (("r", 1, f"len({x}_1)"), ("p", 1, f"len({x}_2)"), ("f", 2, f"(len({x}_1) + len({x}_2))"))), f"{hit} AS h_{x}"


@R.add(f"WITH {_S_ROUGE_WORDS}, h AS (SELECT *, {_s_lcs_prf('name')[1]} FROM t) SELECT variantid_1, variantid_2, {_s_lcs_prf('name')[0]} FROM h")
def rouge_l(spark, d):
    """ROUGE-L of the names: their longest common subsequence of words."""
    return rouge_words(spark, d).select(*IDS, *_prf(E.lcs_words_udf(C("name_1"), C("name_2")), F.size("name_1"), F.size("name_2"), "name_rouge_l"))


@R.add(f"WITH {_S_ROUGE_WORDS}, h AS (SELECT *, {_s_lcs_prf('text')[1]} FROM t) SELECT variantid_1, variantid_2, {_s_lcs_prf('text')[0]} FROM h")
def rouge_l_text(spark, d):
    """ROUGE-L of names with descriptions."""
    return rouge_words(spark, d).select(*IDS, *_prf(E.lcs_words_udf(C("text_1"), C("text_2")), F.size("text_1"), F.size("text_2"), "text_rouge_l"))


def _s_skips(c, single):
    two = f"flatten(list_transform(range(1, len({c}) + 1), lambda i: list_transform({c}[i + 1:i + 5], lambda w: {c}[i] || ' ' || w)))"
    return f"list_concat({two}, {c})" if single else two


@R.add(
    f"WITH {_S_ROUGE_WORDS}, g AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{_s_skips(f'{x}_{k}', u)} AS {x}_{n}_{k}" for x in _ROUGE for n, u in (("s4", False), ("su4", True)) for k in (1, 2)) + " FROM t) SELECT variantid_1, variantid_2, "
    + ", ".join(_s_prf(f"{x}_{n}_1", f"{x}_{n}_2", f"{x}_rouge_{n}") for x in _ROUGE for n in ("s4", "su4"))
    + " FROM g"
)
def rouge_skip(spark, d):
    """ROUGE-S4 and ROUGE-SU4: word pairs at most four words apart, without and with single words."""

    def skips(t, single):
        at = F.sequence(F.lit(0), F.size(t) - 1)
        two = F.flatten(F.transform(at, lambda i: F.transform(F.slice(t, i + 2, F.lit(5)), lambda w: F.concat(F.get(t, i), F.lit(" "), w))))
        return F.when(F.size(t) > 0, F.concat(two, t) if single else two).otherwise(F.array().cast("array<string>"))

    kinds = [(f"{x}_{n}", x, u) for x in _ROUGE for n, u in (("s4", False), ("su4", True))]
    df = rouge_words(spark, d).select(*IDS, *[skips(C(f"{x}_{k}"), u).alias(f"{n}_{k}") for n, x, u in kinds for k in (1, 2)])
    return df.select(*IDS, *[c for n, x, _ in kinds for c in _prf(E.shared_items_udf(C(f"{n}_1"), C(f"{n}_2")), F.size(f"{n}_1"), F.size(f"{n}_2"), n.replace(f"{x}_", f"{x}_rouge_"))])
