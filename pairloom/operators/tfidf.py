"""TF-IDF statistics and cosine, kept relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_join, salted_lookup
from pairloom.scratch import Scratch


def idf_table(texts: DataFrame, tokens: Column) -> DataFrame:
    """``(term, df, idf)`` over the rows of ``texts``: ln((1 + n) / (1 + df)) + 1, n the number of rows."""
    n = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = texts.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def distinct_texts(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct non-null texts of several columns."""
    return df.select(F.explode(F.array(*cols)).alias("text")).where("text IS NOT NULL").distinct()


def text_id(c: Column | str) -> Column:
    """Two hashes of a text, so that whole texts are not carried through joins; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("h"), F.md5(c).alias("m")))


def text_vectors(texts: DataFrame, tokens, scratch: Scratch) -> DataFrame:
    """``(tid, v, norm)`` of distinct texts with a term: TF-IDF weights by term, and their length."""
    texts = texts.select("text", text_id("text").alias("tid"))
    tf = scratch.save(texts.select("tid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("tid", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    total = tf.agg(F.count(F.lit(1)).alias("n")).scalar()
    # stop words stand in most texts
    w = salted_join(tf, idf, ["term"], "df", total, F.col("tid")).select("tid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    # a text's terms as one row: as many entries as it has distinct words
    vec = scratch.save(w.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    scratch.drop(tf)
    return vec


def vector_cosine(va: Column, na: Column, vb: Column, nb: Column) -> Column:
    """Cosine of two ``text_vectors``, only shared terms multiplied; 0 where a side has none."""
    dot = F.aggregate(F.array_intersect(F.map_keys(va), F.map_keys(vb)), F.lit(0.0), lambda acc, t: acc + F.element_at(va, t) * F.element_at(vb, t))
    return F.coalesce(F.try_divide(dot, na * nb), F.lit(0.0))


def tfidf_cosine(df: DataFrame, a: str, b: str, tokens) -> DataFrame:
    """``(a, b, cosine)`` of every distinct pair of texts; 0 where a side has no term.

    Vectors belong to distinct texts, not to rows: each text's norm is found
    once, and a text that many pairs share is tokenised once. Only shared
    terms of a pair are multiplied.
    """
    vec = text_vectors(distinct_texts(df, [a, b]), tokens, Scratch(df.sparkSession, "tfidf"))
    pairs = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().withColumns({"ta": text_id(a), "tb": text_id(b)})
    va, vb = (vec.select(F.col("tid").alias(t), F.col("v").alias(f"v{t}"), F.col("norm").alias(f"n{t}")) for t in ("ta", "tb"))
    # a text may stand in very many pairs
    both = salted_lookup(pairs, va, ["ta"], F.col("tb"), "left")
    both = salted_lookup(both, vb, ["tb"], F.col("ta"), "left")
    return both.select(a, b, vector_cosine(F.col("vta"), F.col("nta"), F.col("vtb"), F.col("ntb")).alias("cosine"))
