"""New pairs by transitivity over a pair graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_pairs
from pairloom.scratch import Scratch


def neighbours(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(src, dst)`` in both directions, distinct, without loops and nulls."""
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    return one.select("u", "v").withColumn("e", F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))).select("e.src", "e.dst")


def transitive_pairs(df: DataFrame, a: str, b: str, levels: int = 1) -> DataFrame:
    """``(u, v)``, u < v, of nodes at distance ``k + 1`` for the first levels, that are no edges yet.

    Each level joins the frontier of pairs with the edges once more. The result
    holds a row for each such pair by definition; to label whole groups without
    pairs use connected components.
    """
    scratch = Scratch(df.sparkSession, "transitive")
    adj = scratch.save(neighbours(df, a, b))
    known = adj.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    reach, out = adj.select(F.col("src").alias("u"), F.col("dst").alias("v")), None
    for _ in range(levels):
        # a hub's square is spread over tasks
        step = salted_pairs(reach, adj.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v"], F.col("u")).where("u <> w").select("u", F.col("w").alias("v")).distinct()
        new = scratch.save(step.where("u < v").join(known, ["u", "v"], "left_anti"))
        out = new if out is None else out.unionByName(new)
        known = known.unionByName(new)
        reach = new.unionByName(new.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return out
