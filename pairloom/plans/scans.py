"""Queries: scans, reshaping, attachment of keyed scores, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pairloom.functions import numbers as N
from pairloom.functions import text as T
from pairloom.operators.ranking import global_rank, running_totals
from pairloom.operators.skew import salted_lookup
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.plans.texts import _s_layout
from pairloom.scratch import Scratch
from pairloom.sources import io
from pairloom.sources.tables import table

R = Registry()
C = F.col
TEST_COLS = ["variantid_1", "variantid_2", "name_1", "name_2", "price_1", "price_2", "n_images_1", "n_images_2", "unique_cat_1"]


def all_pairs(spark, d):
    """Train and test pairs in one frame; test pairs have the label columns as -1."""
    cols = [*TEST_COLS, "group_id", "is_double"]
    return io.read_parts(spark, [f"{d}/train_df.parquet", f"{d}/test_df.parquet"]).select(*cols)


_S_ALL = f"SELECT {', '.join(TEST_COLS)}, group_id, is_double FROM train_df UNION ALL SELECT {', '.join(TEST_COLS)}, -1, -1 FROM test_df"


@R.add(_S_ALL)
def scan_align_union(spark, d):
    return all_pairs(spark, d)


@R.add("SELECT variantid_1, variantid_2, is_double FROM train_df")
def scan_projected(spark, d):
    return io.read_projected(spark, f"{d}/train_df.parquet", [*IDS, "is_double"])


@R.add("SELECT variantid_1, variantid_2, is_double, score FROM oof_scores")
def compact_parquet(spark, d):
    """A table written as few files and read again."""
    path = f"{Scratch(spark, 'compact').root}/out"
    io.compact(table(spark, d, "oof_scores"), path, 2)
    return spark.read.parquet(path)


@R.add("SELECT CASE WHEN is_double = -1 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM (" + _S_ALL + ") GROUP BY 1")
def split_train_test(spark, d):
    df = all_pairs(spark, d).withColumn("part", F.when(C("is_double") == -1, "test").otherwise("train"))
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT DISTINCT doc_id, text FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 1000000")
def corpus_limit(spark, d):
    """The first million documents by id: the feature is the limit. Ids are ranked, texts are not sorted."""
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    first = global_rank(docs.select("doc_id"), Scratch(spark, "corpus"), [F.asc("doc_id")], "rank").where(C("rank") <= 1_000_000)
    return docs.join(first.select("doc_id"), "doc_id", "left_semi")


@R.add("SELECT variantid_1, variantid_2, is_double, unique_cat_1 FROM train_df WHERE unique_cat_1 IN (SELECT category_level_1_1 || '_' || category_level_1_1 FROM train_df)")
def per_category_slice(spark, d):
    """Rows whose sides share one level-1 category: what per-category models are trained on."""
    df = pairs(spark, d).select(*IDS, "is_double", "unique_cat_1", "category_level_1_1")
    own = df.select(F.concat("category_level_1_1", F.lit("_"), "category_level_1_1").alias("unique_cat_1")).distinct()
    return df.drop("category_level_1_1").join(own, "unique_cat_1", "left_semi").select(*IDS, "is_double", "unique_cat_1")


@R.add("SELECT variantid_1, variantid_2, CASE WHEN score > 0.98 THEN 1 ELSE 0 END AS is_double, 777777 AS group_id FROM oof_scores WHERE NOT (score BETWEEN 0.02 AND 0.98)")
def pseudo_label(spark, d):
    """Confident scores as labels under one constant group."""
    df = table(spark, d, "oof_scores").where(~C("score").between(0.02, 0.98))
    return df.select(*IDS, F.when(C("score") > 0.98, 1).otherwise(0).alias("is_double"), F.lit(777777).alias("group_id"))


_FLAGS = ("is_same_location", "is_same_region")
_COUNTS = ("n_images_1", "n_images_2")
_TEXTS = (*[f"category_level_{k}_{i}" for k in (1, 2, 3, 4) for i in (1, 2)], "unique_cat_1")


@R.add(
    "SELECT variantid_1, variantid_2, "
    + ", ".join([*[f"CASE {c} WHEN 1 THEN 'True' WHEN 0 THEN 'False' ELSE 'nan' END AS {c}" for c in _FLAGS], *[f"coalesce({c}::VARCHAR, 'nan') AS {c}" for c in _COUNTS], *[f"coalesce({c}, 'None') AS {c}" for c in _TEXTS]])
    + " FROM train_df"
)
def cast_categoricals(spark, d):
    """Thirteen flags, counts and texts as categories, with explicit names for truth and absence."""
    flags = [F.when(C(c) == 1, "True").when(C(c) == 0, "False").otherwise("nan").alias(c) for c in _FLAGS]
    counts = [F.coalesce(C(c).cast("string"), F.lit("nan")).alias(c) for c in _COUNTS]
    return pairs(spark, d).select(*IDS, *flags, *counts, *[F.coalesce(c, F.lit("None")).alias(c) for c in _TEXTS])


_SCORES = ("userbge_cossim", "fasttext", "rubert_base_trained")


@R.add("SELECT variantid_1, variantid_2, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _SCORES) + " FROM test_df")
def inf_to_null(spark, d):
    return table(spark, d, "test_df").select(*IDS, *[N.finite(C(c)).alias(c) for c in _SCORES])


_NUMERIC = ("price_1", "price_2", "n_images_1", "n_images_2", "is_double")


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS col, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c}) AS n, count(DISTINCT {c}) AS n_distinct FROM train_df" for c in _NUMERIC))
def downcast_ranges(spark, d):
    """Range, count and distinct count of every numeric column, in one aggregation."""
    aggs = [F.struct(F.lit(c).alias("col"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count(c).alias("n"), F.count_distinct(c).alias("n_distinct")).alias(c) for c in _NUMERIC]
    one = pairs(spark, d).agg(*aggs)
    return one.select(F.explode(F.array(*_NUMERIC)).alias("e")).select("e.*")


def narrowest(lo: float, hi: float) -> str:
    """The narrowest integer type whose range holds both bounds strictly."""
    for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        if -(2**bits) < lo and hi < 2**bits - 1:
            return t
    return "bigint"


_WHOLE = ("n_images_1", "n_images_2", "is_double", "is_same_location", "is_same_region")


@R.add("SELECT variantid_1, variantid_2, " + ", ".join(f"{c}::TINYINT AS {c}" for c in _WHOLE) + " FROM train_df")
def downcast(spark, d):
    """Whole-number columns in the narrowest type that holds their range, found in one aggregation."""
    df = pairs(spark, d).select(*IDS, *_WHOLE)
    # one row
    r = df.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(_WHOLE) for n, x in (("lo", F.min(c)), ("hi", F.max(c)))]).first()
    return df.select(*IDS, *[C(c).cast(narrowest(r[f"lo{i}"] or 0, r[f"hi{i}"] or 0)).alias(c) for i, c in enumerate(_WHOLE)])


def counted(df, cols, scratch):
    """``(col, v, n, before)``: the distinct non-null values of each column with their rows and the rows below them."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), C(c).cast("double").alias("v")) for c in cols])).alias("e")).select("e.*").where("v IS NOT NULL")
    values = long.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    return scratch.save(running_totals(values, scratch, [F.asc("v")], {"before": C("n")}, by=["col"]))


_PRICED = ("price_1", "price_2")


@R.add("WITH m AS (SELECT median(price_1) AS m1, median(price_2) AS m2 FROM train_df) SELECT variantid_1, variantid_2, round(coalesce(price_1, m1), 6) AS price_1, round(coalesce(price_2, m2), 6) AS price_2 FROM train_df, m")
def median_impute(spark, d):
    """Missing prices as the exact median, found from ranks: no task holds all values."""
    df = pairs(spark, d).select(*IDS, *_PRICED)
    ranked = counted(df, _PRICED, Scratch(spark, "median"))
    # the middle rows, of which there are at most two a column
    sizes = ranked.groupBy("col").agg(F.sum("n").alias("rows"))
    lower, upper = F.floor((C("rows") - 1) / 2), F.floor(C("rows") / 2)
    holds = lambda at: (C("before") <= at) & (at < C("before") + C("n"))
    middle = ranked.join(F.broadcast(sizes), "col").where(holds(lower) | holds(upper)).groupBy("col").agg(((F.min("v") + F.max("v")) / 2).alias("m"))
    return df.select(*IDS, *[r6(F.coalesce(c, middle.where(C("col") == c).select("m").scalar())).alias(c) for c in _PRICED])


_SCALED = ("price_1", "price_2", "n_images_1", "n_images_2")


@R.add(
    "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _SCALED) + " FROM train_df) SELECT variantid_1, variantid_2, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in _SCALED) + " FROM train_df, m"
)
def standardize(spark, d):
    df = pairs(spark, d).select(*IDS, *_SCALED)
    # one row
    stats = df.agg(*[x.alias(f"{n}_{c}") for c in _SCALED for n, x in (("m", F.avg(c)), ("s", F.stddev(c)))])
    one = lambda n: stats.select(n).scalar()
    return df.select(*IDS, *[r6((C(c) - one(f"m_{c}")) / one(f"s_{c}")).alias(f"z_{c}") for c in _SCALED])


_BINS = 48


@R.add(
    "SELECT variantid_1, variantid_2, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN ((rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) - 1) * {_BINS} // count({c}) OVER ()) END AS bin_{c}" for c in _PRICED)
    + " FROM train_df"
)
def quantile_bins(spark, d):
    """Each price's quantile bin of 48; equal values share the bin of the lowest of them."""
    df = pairs(spark, d).select(*IDS, *_PRICED)
    ranked = counted(df, _PRICED, Scratch(spark, "bins"))
    sizes = ranked.groupBy("col").agg(F.sum("n").alias("rows"))
    bins = ranked.join(F.broadcast(sizes), "col").select("col", "v", F.floor(C("before") * _BINS / C("rows")).alias("bin"))
    for c in _PRICED:
        one = bins.where(C("col") == c).select(C("v").alias(c), C("bin").alias(f"bin_{c}"))
        # one price may stand in very many rows
        df = salted_lookup(df, one, [c], F.concat(*IDS), "left")
    return df.select(*IDS, *[f"bin_{c}" for c in _PRICED])


@R.add("WITH a AS (" + _S_ALL + "), c AS (SELECT unique_cat_1, row_number() OVER (ORDER BY unique_cat_1) - 1 AS code FROM (SELECT DISTINCT unique_cat_1 FROM a WHERE unique_cat_1 IS NOT NULL)) SELECT variantid_1, variantid_2, is_double, coalesce(code, -1)::BIGINT AS code FROM a LEFT JOIN c USING (unique_cat_1)")
def joint_factorize(spark, d):
    """One code per category over train and test together; missing ones are -1."""
    df = all_pairs(spark, d).select(*IDS, "is_double", "unique_cat_1")
    values = df.select("unique_cat_1").where("unique_cat_1 IS NOT NULL").distinct()
    codes = global_rank(values, Scratch(spark, "codes"), [F.asc("unique_cat_1")], "rank").select("unique_cat_1", (C("rank") - 1).alias("code"))
    return df.join(codes, "unique_cat_1", "left").select(*IDS, "is_double", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


_PLACES = 16


@R.add(
    f"""WITH p AS (SELECT DISTINCT variantid_1, variantid_2, concat_keyval_1 AS kv FROM train_df),
    w AS (SELECT variantid_1, variantid_2, kv, coalesce(list_filter(regexp_split_to_array(kv, '\\s+'), lambda x: x <> ''), []) AS w FROM p),
    v AS (SELECT word, row_number() OVER (ORDER BY word) AS code FROM (SELECT DISTINCT unnest(w) AS word FROM w)), m AS (SELECT map_from_entries(list((word, code))) AS m FROM v)
    SELECT variantid_1, variantid_2, list_concat(list_transform(w[1:{_PLACES}], lambda x: m[x]), list_transform(range(greatest({_PLACES} - len(w), 0)), lambda z: 0)) AS codes,
           list_transform(range({_PLACES}), lambda z: z >= len(w)) AS mask FROM w, m"""
)
def vocab_encode_pad(spark, d):
    """Attribute words of each distinct pair and text as codes of one vocabulary, cut or padded to 16 places, with masks."""
    df = pairs(spark, d).select(*IDS, "concat_keyval_1").distinct().withColumn("w", F.coalesce(F.filter(F.split("concat_keyval_1", r"\s+"), lambda w: w != ""), F.array().cast("array<string>")))
    words = df.select(F.explode("w").alias("word")).distinct()
    vocab = global_rank(words, Scratch(spark, "vocab"), [F.asc("word")], "code")
    at = df.select(*IDS, "concat_keyval_1", F.posexplode_outer(F.slice("w", 1, _PLACES)).alias("pos", "word"))
    # a word may stand in most rows; rows are known by their own values
    coded = salted_lookup(at, vocab, ["word"], F.concat(*IDS), "left").groupBy(*IDS, "concat_keyval_1").agg(F.array_sort(F.collect_list(F.when(C("pos").isNotNull(), F.struct("pos", "code")))).alias("c"))
    codes = F.transform("c", lambda e: e["code"])
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(_PLACES) - F.size("c"))
    return coded.select(*IDS, F.concat(codes, pad).alias("codes"), F.transform(F.sequence(F.lit(0), F.lit(_PLACES - 1)), lambda i: i >= F.size("c")).alias("mask"))


@R.add("SELECT doc_id, ntile(8) OVER (ORDER BY doc_id) AS chunk FROM documents")
def chunk_ntile(spark, d):
    """Eight near-equal runs of the sorted ids, the first ones longer by one."""
    df = table(spark, d, "documents").select("doc_id")
    ranked = global_rank(df, Scratch(spark, "chunks"), [F.asc("doc_id")], "rank")
    n = table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()
    small, more = F.floor(n / 8), n % 8
    z = C("rank") - 1
    chunk = F.when(z < more * (small + 1), F.floor(z / (small + 1))).otherwise(more + F.floor((z - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return ranked.select("doc_id", (chunk + 1).cast("int").alias("chunk"))


# keyed attachment


def unique_scores(df, cols):
    """One row per pair: the mean of each score over copies of the pair, nulls ignored."""
    return df.groupBy(*IDS).agg(*[F.avg(c).alias(c) for c in cols])


_S_KEYED = "s AS (SELECT variantid_1, variantid_2, avg(score) AS score FROM oof_scores GROUP BY 1, 2), r AS (SELECT variantid_2 AS variantid_1, variantid_1 AS variantid_2, avg(score) AS reversed FROM oof_scores GROUP BY 1, 2), c AS (SELECT variantid AS variantid_1, count(*) AS n_docs FROM documents WHERE variantid IS NOT NULL GROUP BY 1)"


@R.add(f"WITH {_S_KEYED} SELECT t.variantid_1, t.variantid_2, t.is_double, round(s.score, 6) AS score, round(r.reversed, 6) AS reversed, coalesce(n_docs, 0) AS n_docs FROM train_df t LEFT JOIN s USING (variantid_1, variantid_2) LEFT JOIN r USING (variantid_1, variantid_2) LEFT JOIN c USING (variantid_1)")
def attach_scores(spark, d):
    """Several score tables by their keys, one after the other; a key that occurs several times gives its mean once per row."""
    oof = table(spark, d, "oof_scores")
    s = unique_scores(oof, ["score"])
    r = unique_scores(oof.select(C("variantid_2").alias("variantid_1"), C("variantid_1").alias("variantid_2"), C("score").alias("reversed")), ["reversed"])
    c = table(spark, d, "documents").where("variantid IS NOT NULL").groupBy(C("variantid").alias("variantid_1")).agg(F.count(F.lit(1)).alias("n_docs"))
    out = pairs(spark, d).select(*IDS, "is_double").join(s, IDS, "left").join(r, IDS, "left")
    # a listing may stand in very many pairs
    out = salted_lookup(out, c, ["variantid_1"], C("variantid_2"), "left")
    return out.select(*IDS, "is_double", r6(C("score")).alias("score"), r6(C("reversed")).alias("reversed"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@R.add(
    f"WITH s AS (SELECT variantid_1, variantid_2, min({_s_layout('name_1')}) AS fixed FROM test_df GROUP BY 1, 2), u AS (SELECT variantid_1, variantid_2, name_1 FROM train_df UNION ALL SELECT variantid_1, variantid_2, name_1 FROM test_df)"
    " SELECT u.variantid_1, u.variantid_2, coalesce(fixed, name_1) AS name_1, fixed IS NOT NULL AS is_fixed FROM u LEFT JOIN s USING (variantid_1, variantid_2)"
)
def attach_repaired_text(spark, d):
    """Repaired names by pair key (there for the scored pairs), falling back to the raw name."""
    test = table(spark, d, "test_df")
    fixed = test.groupBy(*IDS).agg(F.min(T.layout_fix("name_1")).alias("fixed"))
    every = pairs(spark, d).select(*IDS, "name_1").unionByName(test.select(*IDS, "name_1"))
    return every.join(fixed, IDS, "left").select(*IDS, F.coalesce("fixed", "name_1").alias("name_1"), C("fixed").isNotNull().alias("is_fixed"))


@R.add("SELECT variantid_1, variantid_2, round(avg(score) OVER (PARTITION BY least(variantid_1, variantid_2), greatest(variantid_1, variantid_2)), 6) AS score FROM oof_scores")
def symmetric_pair_mean(spark, d):
    """A pair's mean score over both orders of its sides."""
    df = table(spark, d, "oof_scores")
    means = df.groupBy(F.least(*IDS).alias("lo"), F.greatest(*IDS).alias("hi")).agg(F.avg("score").alias("m"))
    out = df.select(*IDS, F.least(*IDS).alias("lo"), F.greatest(*IDS).alias("hi")).join(means, ["lo", "hi"])
    return out.select(*IDS, r6(C("m")).alias("score"))


_S_FINITE = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END" for c in _SCORES)


@R.add(f"SELECT variantid_1, variantid_2, round(avg(v), 9) AS score, count(v) AS n_models FROM (SELECT variantid_1, variantid_2, unnest([{_S_FINITE}]) AS v FROM test_df) GROUP BY 1, 2")
def fold_mean(spark, d):
    """Mean over the scores of several models, those that are there; null where none is."""
    df = table(spark, d, "test_df").select(*IDS, F.explode(F.array(*[N.finite(C(c)) for c in _SCORES])).alias("v"))
    return df.groupBy(*IDS).agg(F.round(F.avg("v"), 9).alias("score"), F.count("v").alias("n_models"))


_FOLDS = 5


@R.add(
    f"""WITH f AS (SELECT variantid_1, variantid_2, min(coalesce(group_id, 0) % {_FOLDS})::INTEGER AS fold FROM train_df WHERE is_double IN (0, 1) AND coalesce(group_id, 0) >= 0 GROUP BY 1, 2)
    SELECT variantid_1, variantid_2, fold, max(score) AS score FROM f JOIN oof_scores USING (variantid_1, variantid_2) GROUP BY 1, 2, 3"""
)
def oof_assemble(spark, d):
    """Each fold's predictions of its own pairs, put together: every labelled pair is predicted once."""
    group = F.coalesce("group_id", F.lit(0))
    folds = pairs(spark, d).where(C("is_double").isin(0, 1) & (group >= 0)).groupBy(*IDS).agg(F.min(group % _FOLDS).cast("int").alias("fold"))
    scored = folds.join(table(spark, d, "oof_scores").select(*IDS, "score"), IDS)
    parts = [scored.where(C("fold") == k).groupBy(*IDS, "fold").agg(F.max("score").alias("score")) for k in range(_FOLDS)]
    return reduce(lambda x, y: x.unionByName(y), parts)


@R.add(
    """WITH r AS (SELECT variantid_2 AS variantid_1, variantid_1 AS variantid_2, avg(score) AS back FROM oof_scores GROUP BY 1, 2)
    SELECT variantid_1, variantid_2, round(CASE WHEN back IS NULL THEN score ELSE (score + back) / 2 END, 6) AS score, back IS NOT NULL AS both_ways FROM oof_scores LEFT JOIN r USING (variantid_1, variantid_2)"""
)
def tta_mean(spark, d):
    """Mean of a pair's score and that of the pair with its sides exchanged, where there is one."""
    oof = table(spark, d, "oof_scores").select(*IDS, "score")
    back = oof.groupBy(C("variantid_2").alias("variantid_1"), C("variantid_1").alias("variantid_2")).agg(F.avg("score").alias("back"))
    out = oof.join(back, IDS, "left")
    return out.select(*IDS, r6(F.when(C("back").isNull(), C("score")).otherwise((C("score") + C("back")) / 2)).alias("score"), C("back").isNotNull().alias("both_ways"))
