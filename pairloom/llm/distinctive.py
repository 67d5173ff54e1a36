"""How distinctive a term is per record: residual inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_join
from pairloom.scratch import Scratch

TERM = r"[\p{L}\p{N}]{%d,}"


def records(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """``(id, text)``: one record per distinct non-null id, fields joined by blanks, null as empty.

    Where copies of an id differ, the least joined text counts.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text).alias("text"))


def term_counts(df: DataFrame, id_col: str, text_cols: list[str], min_len: int = 3) -> DataFrame:
    """``(id, term, tf)``: how often each term stands in each record.

    A term is a maximal run of letters and digits of at least ``min_len``
    characters, lower-cased. A record without terms gives no rows. The records
    are already partitioned by id, so counting within them adds no shuffle.
    """
    words = F.regexp_extract_all("text", F.lit(TERM % min_len), F.lit(0))
    terms = records(df, id_col, text_cols).select("id", F.explode(words).alias("term")).select("id", F.lower("term").alias("term"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def collection_counts(counts: DataFrame) -> DataFrame:
    """``(term, df, cf)``: records that hold the term, and its occurrences in all."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def term_weights(df: DataFrame, id_col: str, text_cols: list[str], min_len: int = 3) -> DataFrame:
    """``(id, term, tf, df, cf, ridf, weight)`` for every term of every record.

    With N records, ``ridf = -log2(df / N) + log2(1 - exp(-cf / N))``: the
    observed inverse document frequency minus the one that a Poisson spread of
    the same ``cf`` occurrences would give; ``weight = tf * ridf``. Terms spread
    evenly score about 0 or less, terms concentrated in few records high. All
    statistics are over all records; counts are staged once. An empty table gives no rows. Terms that
    stand everywhere are salted in the join that brings the statistics back.
    """
    scratch = Scratch(df.sparkSession, "terms")
    counts = scratch.save(term_counts(df, id_col, text_cols, min_len))
    stats = scratch.save(collection_counts(counts))
    n = df.where(F.col(id_col).isNotNull()).agg(F.count_distinct(id_col).alias("n")).scalar()
    total = stats.agg(F.sum("df").alias("t")).scalar()
    both = salted_join(counts, stats, ["term"], "df", total, F.col("id"))
    poisson = -F.log2(-F.expm1(-F.col("cf") / n))
    ridf = -F.log2(F.col("df") / n) - poisson
    return both.select(F.col("id").alias(id_col), "term", "tf", "df", "cf", ridf.alias("ridf"), (F.col("tf") * ridf).alias("weight"))


def concentrated_terms(df: DataFrame, id_col: str, text_cols: list[str], min_tf: int = 3, min_df: int = 2, max_df: int = 5) -> DataFrame:
    """Terms of ``term_weights`` that stand often in a record and in few records at all.

    The case is stated by those two counts; the weights that come with it order
    it. Both bounds reach their side of the join before it: rows below ``min_tf``
    and terms outside the ``df`` range are not shuffled for it.
    """
    return term_weights(df, id_col, text_cols).where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
