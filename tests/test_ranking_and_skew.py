import random

from pyspark.sql import functions as F

from pairloom.operators.ranking import global_rank, running_totals
from pairloom.operators.skew import salted_join
from pairloom.scratch import Scratch


def test_global_rank(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(data, "i int, g string, v int")
    got = {r["i"]: r["rk"] for r in global_rank(df, Scratch(spark, "t"), [F.desc("v"), F.asc("i")], "rk", by=["g"], partitions=7).collect()}
    for g in "ab":
        order = sorted((x for x in data if x[1] == g), key=lambda x: (-x[2], x[0]))
        assert [got[x[0]] for x in order] == list(range(1, len(order) + 1))
    assert global_rank(df.where("i < 0"), Scratch(spark, "t"), [F.asc("i")], "rk").collect() == []


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(40)], "i int, v int")
    got = {r["i"]: (r["a"], r["b"]) for r in running_totals(df, Scratch(spark, "t"), [F.asc("i")], {"a": F.col("v"), "b": F.lit(2)}, partitions=5).collect()}
    assert got == {i: (sum(j * j for j in range(i)), 2 * i) for i in range(40)}


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "lonely"])) for i in range(1000)], "i int, k string")
    right = left.where("k IS NOT NULL AND k <> 'lonely'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(left, right, ["k"], "n", right.agg(F.sum("n")).scalar(), F.col("i"), parts=10)
    assert sorted(map(tuple, out.select("i", "k", "n").collect())) == sorted(map(tuple, left.join(right, "k").select("i", "k", "n").collect()))
