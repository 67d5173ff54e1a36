"""Distributed classifiers behind the score-column contract."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import salted_lookup
from pairloom.scratch import Scratch


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, features: int = 1 << 14, iterations: int = 8) -> DataFrame:
    """``df`` with ``fold`` and ``score``: each row by a logistic model of the other folds.

    ``tokens`` (array of strings) are the features, hashed; ``is_double`` the
    label. All labelled rows train; null groups match the fold of the null
    group. Rows whose group has no fold are dropped.
    """
    # a null group is a value of its own; a group may hold very many rows
    key = lambda d: d.withColumns({"__none": F.col(group).isNull(), "__group": F.coalesce(F.col(group).cast("string"), F.lit(""))})
    both = salted_lookup(key(df), key(folds).drop(group), ["__none", "__group"], F.xxhash64("tokens")).drop("__none", "__group")
    rows = Scratch(df.sparkSession, "learn").save(both.withColumn("label", F.col("is_double").cast("double")))
    rows = HashingTF(inputCol="tokens", outputCol="features", numFeatures=features).transform(rows)
    n = folds.agg(F.max("fold")).first()[0]
    out = None
    for k in range((n if n is not None else -1) + 1):
        model = LogisticRegression(maxIter=iterations, regParam=0.01, standardization=False).fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumn("score", F.lit(None).cast("double"))
    return out.drop("features", "label", "rawPrediction", "probability", "prediction")
