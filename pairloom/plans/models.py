"""Queries: evaluation, folds, blending, vectors, graphs and model stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions import vectors as V
from pairloom.operators import blending as B
from pairloom.operators.char_lm import gram_counts, perplexity
from pairloom.operators.evaluation import group_folds, pr_auc as pr_area, pr_points
from pairloom.operators.graph import neighbours, transitive_pairs as new_pairs
from pairloom.operators.ranking import global_rank
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.scratch import Scratch
from pairloom.sources.tables import table

R = Registry()
C = F.col


def oof(spark, d):
    return table(spark, d, "oof_scores")


_S_PR = """WITH g AS (SELECT score AS s, sum(is_double)::DOUBLE AS p, count(*)::DOUBLE AS n FROM oof_scores WHERE score IS NOT NULL GROUP BY 1),
    c AS (SELECT s, p, sum(p) OVER w AS tp, sum(n) OVER w AS n, sum(p) OVER () AS pos FROM g WINDOW w AS (ORDER BY s DESC)),
    k AS (SELECT s, tp / n AS pr, tp / pos AS re, coalesce(lag(tp / n) OVER (ORDER BY s DESC), 1) AS pr0, coalesce(lag(tp / pos) OVER (ORDER BY s DESC), 0) AS re0 FROM c)"""


@R.add(f"{_S_PR} SELECT round(sum((re - re0) * (pr + pr0) / 2), 6) AS pr_auc FROM k")
def pr_auc(spark, d):
    return pr_area(pr_points(oof(spark, d), "score", "is_double", Scratch(spark, "pr"))).select(r6(C("pr_auc")).alias("pr_auc"))


@R.add(f"{_S_PR} SELECT round(sum((re - re0) * pr), 6) AS average_precision FROM k")
def average_precision(spark, d):
    return pr_area(pr_points(oof(spark, d), "score", "is_double", Scratch(spark, "ap"))).select(r6(C("average_precision")).alias("average_precision"))


@R.add(
    """WITH c AS (SELECT count_if(score >= 0.5 AND is_double = 1)::DOUBLE AS tp, count_if(score >= 0.5 AND is_double = 0) AS fp, count_if(score < 0.5 AND is_double = 1) AS fn, count(*) AS n,
        count_if((score >= 0.5) = (is_double = 1)) AS ok FROM oof_scores WHERE score IS NOT NULL)
    SELECT round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def threshold_metrics(spark, d):
    hit, pos = C("score") >= 0.5, C("is_double") == 1
    c = oof(spark, d).where("score IS NOT NULL").agg(F.count_if(hit & pos).cast("double").alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count(F.lit(1)).alias("n"), F.count_if(hit == pos).alias("ok"))
    div = lambda a, b: r6(F.try_divide(a, b))
    tp, fp, fn = C("tp"), C("fp"), C("fn")
    return c.select(div(C("ok"), C("n")).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


@R.add("SELECT is_double, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM train_df), 6) AS share FROM train_df GROUP BY 1")
def label_balance(spark, d):
    c = pairs(spark, d).groupBy("is_double").agg(F.count(F.lit(1)).alias("n"))
    return c.select("is_double", "n", r6(C("n") / c.agg(F.sum("n")).scalar()).alias("share"))


@R.add("WITH c AS (SELECT is_double, count(*) AS n FROM train_df WHERE is_double IN (0, 1) GROUP BY 1) SELECT is_double, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, d):
    c = pairs(spark, d).where("is_double IN (0, 1)").groupBy("is_double").agg(F.count(F.lit(1)).alias("n"))
    return c.select("is_double", r6(c.agg(F.sum("n")).scalar().cast("double") / (c.agg(F.count(F.lit(1))).scalar() * C("n"))).alias("weight"))


@R.add("SELECT floor(least(score, 0.999999) * 20)::INTEGER AS bin, count(*) AS n FROM oof_scores WHERE score IS NOT NULL GROUP BY 1")
def prob_histogram(spark, d):
    return oof(spark, d).where("score IS NOT NULL").groupBy(F.floor(F.least(C("score"), F.lit(0.999999)) * 20).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def labelled(spark, d):
    """All labelled pairs with ``unit``: the group, or without one (null or -1) the two records in any order, as in ``p3_splits``."""
    pair = F.concat_ws("|", F.lit("pair"), F.least(*IDS), F.greatest(*IDS))
    unit = F.when(C("group_id") != -1, F.concat(F.lit("g"), C("group_id").cast("string"))).otherwise(pair)
    return pairs(spark, d).where("is_double IN (0, 1)").withColumn("unit", unit)


def _folds(spark, d, stratified):
    """One row per unit; ``group_id`` is null where the unit is a pair without group."""
    group = F.when(C("unit").startswith("g"), F.substring("unit", 2, 20).cast("long"))
    return group_folds(labelled(spark, d), "unit", "is_double", 5, stratified).select(group.alias("group_id"), "unit", "fold")


@R.add()
def stratified_group_kfold(spark, d):
    return _folds(spark, d, True)


@R.add()
def group_kfold(spark, d):
    return _folds(spark, d, False)


@R.add("SELECT DISTINCT group_id, 1 AS stratified, 1 AS plain FROM train_df WHERE is_double IN (0, 1) AND group_id <> -1")
def kfold_whole(spark, d):
    """In how many folds each labelled group stands: one, by either rule."""
    rows = labelled(spark, d).where("group_id <> -1").select("group_id", "unit").distinct()
    out = None
    for name, stratified in (("stratified", True), ("plain", False)):
        n = rows.join(_folds(spark, d, stratified).select("unit", "fold"), "unit").groupBy("group_id").agg(F.count_distinct("fold").cast("int").alias(name))
        out = n if out is None else out.join(n, "group_id")
    return out


def predictions(spark, d):
    """Three deterministic scores per test pair, from its usable raw scores."""
    squash = lambda c: 1 / (1 + F.exp(-F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < 700), C(c)), F.lit(0.0))))
    return table(spark, d, "test_df").select(*IDS, "unique_cat_1", squash("userbge_cossim").alias("p_all"), squash("fasttext").alias("p_first"), squash("rubert_base_trained").alias("p_second"))


def _s_squash(c):
    return f"1 / (1 + exp(-coalesce(CASE WHEN NOT isnan({c}) AND abs({c}) < 700 THEN {c} END, 0.0::DOUBLE)))"


_S_PRED = f"p AS (SELECT variantid_1, variantid_2, unique_cat_1, {_s_squash('userbge_cossim')} AS p_all, {_s_squash('fasttext')} AS p_first, {_s_squash('rubert_base_trained')} AS p_second FROM test_df)"


@R.add(f"WITH {_S_PRED} SELECT unique_cat_1, round(avg(p_all), 6) AS p_all, round(avg(p_first), 6) AS p_first, round(avg(p_second), 6) AS p_second FROM p GROUP BY 1")
def category_mean_prob(spark, d):
    return predictions(spark, d).groupBy("unique_cat_1").agg(*[r6(F.avg(c)).alias(c) for c in ("p_all", "p_first", "p_second")])


# example factors: a parameter of the operator, keyed by category
_FACTORS = {"Электроника_Электроника": 1.2, "Одежда_Одежда": 0.9, "Запчасти_Запчасти": 1.5}
_S_FACTOR = "CASE unique_cat_1 " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _FACTORS.items()) + " ELSE 1 END"


@R.add(f"WITH {_S_PRED} SELECT variantid_1, variantid_2, round(greatest(least((0.5 * p_all + 0.5 * (0.7 * p_first + 0.3 * p_second)) * {_S_FACTOR}, 1), 0), 6) AS probability FROM p")
def blend_postprocess(spark, d):
    """Blend of overall and category scores, times the category's factor, clipped."""
    return predictions(spark, d).select(*IDS, r6(B.scaled(B.blend(C("p_all"), C("p_first"), C("p_second")), C("unique_cat_1"), _FACTORS)).alias("probability"))


@R.add(
    f"""WITH {_S_PRED}, m AS (SELECT unique_cat_1, avg(p_all) AS pi, avg(p_first) AS r1, avg(p_second) AS r2 FROM p GROUP BY 1)
    SELECT variantid_1, variantid_2, round(p_first * pi * (1 - r1) / (p_first * pi * (1 - r1) + (1 - p_first) * (1 - pi) * r1), 6) AS p_first,
           round(p_second * pi * (1 - r2) / (p_second * pi * (1 - r2) + (1 - p_second) * (1 - pi) * r2), 6) AS p_second FROM p JOIN m USING (unique_cat_1)"""
)
def prior_align(spark, d):
    out = B.align_to_prior(predictions(spark, d), "unique_cat_1", "p_all", ["p_first", "p_second"])
    return out.select(*IDS, r6(C("p_first")).alias("p_first"), r6(C("p_second")).alias("p_second"))


@R.add(
    f"""WITH {_S_PRED}, m AS (SELECT unique_cat_1, avg(p_all) AS pi, avg(p_first) AS r1, avg(p_second) AS r2 FROM p GROUP BY 1),
    a AS (SELECT *, p_first * pi * (1 - r1) / (p_first * pi * (1 - r1) + (1 - p_first) * (1 - pi) * r1) AS a1, p_second * pi * (1 - r2) / (p_second * pi * (1 - r2) + (1 - p_second) * (1 - pi) * r2) AS a2 FROM p JOIN m USING (unique_cat_1))
    SELECT variantid_1, variantid_2, round(greatest(least(0.5 * p_all + 0.5 * coalesce(0.7 * a1 + 0.3 * a2, p_all), 1), 0), 6) AS probability FROM a"""
)
def aligned_blend(spark, d):
    """The blend of the overall score with category scores that were aligned to its prior."""
    out = B.align_to_prior(predictions(spark, d), "unique_cat_1", "p_all", ["p_first", "p_second"])
    return out.select(*IDS, r6(B.scaled(B.blend(C("p_all"), C("p_first"), C("p_second")), C("unique_cat_1"), {})).alias("probability"))


# vectors


def vector_pairs(spark, d):
    """Vectors of one label whose places by id are at most five apart."""
    e = table(spark, d, "embeddings")
    place = global_rank(e, Scratch(spark, "vectors"), [F.asc("vec_id")], "rk", by=["label"])
    near = place.select("label", C("vec_id").alias("a"), C("embedding").alias("ea"), F.explode(F.sequence(C("rk") + 1, C("rk") + 5)).alias("rk"))
    return near.join(place.select("label", "rk", C("vec_id").alias("b"), C("embedding").alias("eb")), ["label", "rk"])


_S_VEC = "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM embeddings), v AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.embedding AS ea, b.embedding AS eb FROM r a JOIN r b ON a.label = b.label AND b.rk BETWEEN a.rk + 1 AND a.rk + 5)"


@R.add(f"WITH {_S_VEC} SELECT a, b, round(list_cosine_similarity(list_transform(ea, lambda x: x::DOUBLE), list_transform(eb, lambda x: x::DOUBLE)), 6) AS cosine FROM v")
def embedding_pair_cosine(spark, d):
    return vector_pairs(spark, d).select("a", "b", r6(V.cosine(C("ea"), C("eb"))).alias("cosine"))


_S_DOUBLES = "list_transform({0}, lambda x: x::DOUBLE)"


@R.add(f"WITH {_S_VEC} SELECT a, b, list_concat(ea, eb) AS joined FROM v")
def embedding_concat(spark, d):
    """Both embeddings as one vector."""
    return vector_pairs(spark, d).select("a", "b", F.concat("ea", "eb").alias("joined"))


@R.add(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM e)"
    " SELECT vec_id, list_transform(e, lambda x: round(x / n, 6)) AS unit, round((list_sum(list_transform(e, lambda x: greatest(x, 1e-6) ** 3)) / len(e)) ** (1.0::DOUBLE / 3), 6) AS gem FROM n"
)
def embedding_pooling(spark, d):
    """Embeddings of length one, and their generalised mean of power three."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(V.normalized(C("embedding")), lambda x: F.round(x, 6)).alias("unit"), r6(V.power_mean(C("embedding"))).alias("gem"))


@R.add("SELECT variantid AS filename FROM documents WHERE variantid IS NOT NULL AND variantid NOT IN (SELECT variantid_1 FROM test_df) GROUP BY 1")
def missing_embeddings(spark, d):
    """Names that are wanted and not there yet."""
    want = table(spark, d, "documents").select(C("variantid").alias("filename")).where("filename IS NOT NULL").distinct()
    return want.join(table(spark, d, "test_df").select(C("variantid_1").alias("filename")), "filename", "left_anti")


_MARGIN = 0.5


@R.add(
    f"""WITH x AS (SELECT 1 - score AS dist, is_double AS y FROM oof_scores WHERE score IS NOT NULL),
    e AS (SELECT max(CASE WHEN y = 1 THEN dist END) AS pmax, min(CASE WHEN y = 0 THEN dist END) AS nmin FROM x),
    h AS (SELECT CASE WHEN y = 1 AND dist > nmin THEN dist * dist WHEN y = 0 AND dist < pmax THEN greatest({_MARGIN} - dist, 0) ** 2 END AS l FROM x, e)
    SELECT round(sum(l) / (count(l) + 1e-8), 6) AS online, (SELECT round(avg(0.5 * CASE WHEN y = 1 THEN dist * dist ELSE greatest({_MARGIN} - dist, 0) ** 2 END), 6) FROM x) AS common FROM h"""
)
def contrastive_loss(spark, d):
    """Hard-pair and plain contrastive loss of a cosine score, margin 0.5."""
    x = oof(spark, d).where("score IS NOT NULL").select((1 - C("score")).alias("dist"), C("is_double").alias("y"))
    e = x.agg(F.max(F.when(C("y") == 1, C("dist"))).alias("pmax"), F.min(F.when(C("y") == 0, C("dist"))).alias("nmin"))
    far = F.pow(F.greatest(_MARGIN - C("dist"), F.lit(0.0)), F.lit(2))
    pos = C("y") == 1
    hard = F.when(pos & (C("dist") > e.select("nmin").scalar()), C("dist") * C("dist")).when(~pos & (C("dist") < e.select("pmax").scalar()), far)
    return x.agg(r6(F.sum(hard) / (F.count(hard) + 1e-8)).alias("online"), r6(F.avg(0.5 * F.when(pos, C("dist") * C("dist")).otherwise(far))).alias("common"))


# graphs

_S_EDGES = "SELECT DISTINCT least(variantid_1, variantid_2) AS u, greatest(variantid_1, variantid_2) AS v FROM train_df WHERE is_double = {0} AND variantid_1 <> variantid_2"
_S_WEDGES = "SELECT DISTINCT x.d AS u, y.d AS v FROM {0} x JOIN {0} y ON x.s = y.s AND x.d < y.d WHERE (x.d, y.d) NOT IN (SELECT (u, v) FROM {1})"


def _s_adj(name, edges):
    return f"{name} AS (SELECT u AS s, v AS d FROM {edges} UNION ALL SELECT v, u FROM {edges})"


@R.add(f"WITH e AS ({_S_EDGES.format(1)}), {_s_adj('a', 'e')} {_S_WEDGES.format('a', 'e')}")
def transitive_pairs(spark, d):
    """Pairs two confirmed duplicates apart that are no pair yet."""
    return new_pairs(pairs(spark, d).where("is_double = 1").select(*IDS), *IDS)


@R.add(
    f"""WITH e AS ({_S_EDGES.format(1)}), {_s_adj('a', 'e')}, p AS ({_S_WEDGES.format('a', 'e')}), n AS ({_S_EDGES.format(0)}), {_s_adj('b', 'n')}, q AS ({_S_WEDGES.format('b', 'n')}),
    k AS (SELECT u, v FROM q WHERE (u, v) NOT IN (SELECT (u, v) FROM p) AND (u, v) NOT IN (SELECT (u, v) FROM e) QUALIFY row_number() OVER (ORDER BY u, v) <= (SELECT count(*) * 2 FROM p))
    SELECT u, v, 1 AS is_double FROM p UNION ALL SELECT u, v, 0 FROM k"""
)
def transitive_pairs_balanced(spark, d):
    """New positive pairs with, in id order, twice as many new negative ones: the cap is the feature."""
    df = pairs(spark, d).select(*IDS, "is_double")
    scratch = Scratch(spark, "balanced")
    pos = scratch.save(new_pairs(df.where("is_double = 1"), *IDS))
    old = neighbours(df.where("is_double = 1"), *IDS).where("src < dst").select(C("src").alias("u"), C("dst").alias("v"))
    neg = new_pairs(df.where("is_double = 0"), *IDS).join(pos, ["u", "v"], "left_anti").join(old, ["u", "v"], "left_anti")
    ranked = global_rank(neg, scratch, [F.asc("u"), F.asc("v")], "rk").where(C("rk") <= pos.agg(F.count(F.lit(1))).scalar() * 2)
    return pos.select("u", "v", F.lit(1).alias("is_double")).unionByName(ranked.select("u", "v", F.lit(0).alias("is_double")))


# language model and classifiers

_S_TRI = "SELECT substring(t, i, 3) AS gram FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT array_to_string(regexp_extract_all(lower(text), '[a-zа-я]+'), ' ') AS t FROM documents))"


@R.add(f"SELECT gram, count(*) AS n FROM ({_S_TRI}) GROUP BY 1")
def char_ngram_lm(spark, d):
    """Counts of the three-character runs of the corpus in two alphabets: a character model's table."""
    return char_trigrams(table(spark, d, "documents"), "text")


def char_trigrams(df, text):
    """``(gram, n)``; two alphabets and the blank bound the table to 59^3 rows whatever the corpus."""
    return gram_counts(df, text, 3, 3)


_S_LETTERS = "array_to_string(regexp_extract_all(lower({0}), '[a-zа-я]+'), ' ')"
_S_LM = f"""d AS (SELECT {_S_LETTERS.format('text')} AS t FROM documents),
    c AS (SELECT gram, count(*) AS n FROM (SELECT substring(t, i, k) AS gram FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM d) x, range(1, 6) r(k) WHERE i + k - 1 <= length(t)) GROUP BY 1)"""


@R.add(f"WITH {_S_LM} SELECT gram, n FROM c")
def char_5gram_counts(spark, d):
    """Counts of the runs of one to five characters of the corpus."""
    return gram_counts(table(spark, d, "documents"), "text")


@R.add(
    f"""WITH {_S_LM}, n AS (SELECT sum(n)::DOUBLE AS total FROM c WHERE length(gram) = 1), x AS (SELECT DISTINCT name_1 AS text FROM train_df WHERE name_1 IS NOT NULL),
    y AS (SELECT text, {_S_LETTERS.format('text')} AS t FROM x), w AS (SELECT text, substring(t, greatest(i - 4, 1), least(i, 5)) AS w FROM (SELECT text, t, unnest(range(1, length(t) + 1)) AS i FROM y)),
    u AS (SELECT DISTINCT w FROM w), s AS (SELECT w, k, right(w, k) AS gram, left(right(w, k), k - 1) AS ctx FROM u, range(1, 6) r(k) WHERE k <= length(w)),
    h AS (SELECT w, arg_max(a.n / CASE WHEN k = 1 THEN total ELSE b.n END * 0.4 ** (length(w) - k), k) AS p FROM s JOIN c a USING (gram) LEFT JOIN c b ON b.gram = ctx, n GROUP BY 1),
    f AS (SELECT text, count(*) AS n_chars, exp(-avg(ln(coalesce(p, 1 / (total + 1))))) AS p FROM w LEFT JOIN h USING (w), n GROUP BY 1)
    SELECT x.text, n_chars, round(p, 4) AS perplexity FROM x LEFT JOIN f USING (text)"""
)
def char_perplexity(spark, d):
    """Perplexity of every distinct name under the corpus's character model."""
    scratch = Scratch(spark, "lm")
    counts = scratch.save(gram_counts(table(spark, d, "documents"), "text"))
    out = perplexity(pairs(spark, d), "name_1", counts, scratch)
    return out.select("text", "n_chars", F.round("perplexity", 4).alias("perplexity"))


@R.add()
def homoglyph_fix(spark, d):
    """Words of mixed alphabets rewritten to the alphabet that a character model finds likelier."""
    from pairloom.operators.homoglyphs import repair

    docs = table(spark, d, "documents").select("doc_id", "text")
    return repair(docs, "text", char_trigrams(docs, "text")).select("doc_id", "text", "fixed", "n_fixed")


@R.add()
def bow_classifier(spark, d):
    """Out-of-fold scores of a hashed bag-of-words classifier, each labelled row by the model that did not see its group (or pair, where it has none)."""
    from pairloom.operators.learners import out_of_fold

    df = labelled(spark, d).select(*IDS, "unit", "is_double", F.array_union(T.words(F.lower("name_1")), F.transform(T.words(F.lower("name_2")), F.upper)).alias("tokens"))
    return out_of_fold(df, group_folds(df, "unit", "is_double", 3), "unit").select(*IDS, "fold", "is_double", "score")


@R.add()
def per_category_model(spark, d):
    """The same with every token also crossed with its category: one fit, its own weights per category."""
    from pairloom.operators.learners import out_of_fold

    shared = F.array_intersect(T.words(F.lower("name_1")), T.words(F.lower("name_2")))
    one = F.array_except(F.array_union(T.words(F.lower("name_1")), T.words(F.lower("name_2"))), shared)
    marks = F.concat(F.transform(shared, lambda w: F.lit("same")), F.transform(one, lambda w: F.when(w.rlike("[0-9]"), "other number").otherwise("other word")))
    crossed = F.concat(marks, F.transform(marks, lambda m: F.concat(C("unique_cat_1"), F.lit("|"), m)))
    df = labelled(spark, d).select(*IDS, "unit", "unique_cat_1", "is_double", crossed.alias("tokens"))
    return out_of_fold(df, group_folds(df, "unit", "is_double", 3), "unit").select(*IDS, "unique_cat_1", "fold", "is_double", "score")
