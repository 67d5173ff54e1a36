"""Joins of hot keys give the plain join's rows."""

from collections import Counter

from pyspark.sql import functions as F

from pairloom.operators.skew import salted_join, salted_lookup, salted_pairs


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_many_to_many(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)], "k string, a int")
    right = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(90)] + [(None, -1), ("gone", 0)], "k string, b int")
    got = salted_pairs(left, right, ["k"], F.col("a"), parts=10)
    assert rows(got.select("k", "a", "b")) == rows(left.join(right, "k").select("k", "a", "b"))
    assert salted_pairs(left.limit(0), right, ["k"], F.col("a")).collect() == []


def test_lookup(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)] * 3, "k string, a int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, b int")
    for how in ("inner", "left", "left_anti"):
        got, want = salted_lookup(left, right, ["k"], F.col("a"), how, parts=10), left.join(right, "k", how)
        assert rows(got.select(*want.columns)) == rows(want)


def test_hot_key_is_spread(spark):
    """One key with half of the rows: no task of the join holds more than a small share of them."""
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = salted_join(left, right, ["k"], "n", F.lit(40_000), F.col("id"))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
