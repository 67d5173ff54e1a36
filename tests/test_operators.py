import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.antiwords import anti_word_score, anti_words
from pairloom.operators.attribute_idf import attribute_idf
from pairloom.operators.evaluation import group_folds, pr_auc, pr_points
from pairloom.operators.graph import transitive_pairs
from pairloom.operators.homoglyphs import CharModel
from pairloom.scratch import Scratch, shared_dir


def test_pr_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (None, 1)], "s double, y int")
    r = pr_auc(pr_points(df, "s", "y", Scratch(spark, "t"))).first()
    assert r["pr_auc"] == pytest.approx(0.791667, abs=1e-6) and r["average_precision"] == pytest.approx(0.833333, abs=1e-6)


@pytest.mark.parametrize("limit", [100_000, 10])
def test_folds_keep_groups_whole(spark, limit):
    rng = random.Random(2)
    rows = [(g, int(rng.random() < 0.2)) for g in range(60) for _ in range(rng.randint(1, 30))] + [(99, 0)] * 300
    df = spark.createDataFrame(rows, "g long, y int")
    for strat in (True, False):
        got = group_folds(df, "g", "y", 5, strat, limit).collect()
        assert sorted(r["g"] for r in got) == sorted({g for g, _ in rows})
        if limit > 10:
            fold = {r["g"]: r["fold"] for r in got}
            sizes = [sum(fold[g] == k for g, _ in rows) for k in range(5)]
            assert min(sizes) > 0.6 * (len(rows) - 300) / 5


def test_attribute_idf(spark):
    items = spark.createDataFrame([("c", [("a", "1")]), ("c", [("a", "1")]), ("c", [("a", "2")]), ("c", None), (None, [("a", "9")])], "cat string, e array<struct<key:string,value:string>>")
    r = attribute_idf(items, "cat", "e").collect()
    assert len(r) == 1 and r[0]["n_items"] == 4 and r[0]["score"] == pytest.approx(0.304099, abs=1e-6)


def test_anti_words(spark):
    df = spark.createDataFrame([("case red", "case blue"), ("ab1cdx red", "red"), (None, "red")], "a string, b string")
    got = {r["word"]: r["n"] for r in anti_words(df, "a", "b").collect()}
    assert got == {"red": 2, "blue": 1, "cdx": 1}
    s = df.limit(1).select(anti_word_score(F.col("a"), F.col("b"), F.array(F.lit("red"))).alias("s")).first()["s"]
    assert s == 0.5


def test_transitive_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "c"), (None, "a"), ("c", "d")], "x string, y string")
    assert sorted(map(tuple, transitive_pairs(df, "x", "y").collect())) == [("a", "c"), ("b", "d")]
    assert sorted(map(tuple, transitive_pairs(df, "x", "y", 2).collect())) == [("a", "c"), ("a", "d"), ("b", "d")]


def test_homoglyphs():
    counts = {}
    for t in ["кот ест рыбу", "кот и дом", "рыба кота"] * 5:
        for i in range(len(t) - 2):
            counts[t[i : i + 3]] = counts.get(t[i : i + 3], 0) + 1
    assert CharModel(counts).fix("кoт и дом") == ("кот и дом", 1)
    assert CharModel(counts).fix("") == ("", 0)


def test_stages_are_in_the_shared_folder(spark):
    s = Scratch(spark, "t")
    df = s.save(spark.range(3))
    assert df._pairloom_path.startswith(shared_dir(spark)) and df.count() == 3
    s.drop(df)
