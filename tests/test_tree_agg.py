import random
from collections import defaultdict

import pytest

from pairloom.operators.tree_agg import approx_distinct, count_rows, count_values, frequent_keys, max_of, mean_of, min_of, sum_of, tree_aggregate


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else rng.choice("abcdefg") if rng.random() < 0.9 else None, rng.choice([None, rng.randint(-9, 9)])) for _ in range(n)]


@pytest.mark.parametrize("chunk,fan", [(7, 2), (100, 4), (65536, 16), (1, 3)])
def test_matches_brute_force(spark, chunk, fan):
    data = rows()
    df = spark.createDataFrame(data, "k string, v int").repartition(5)
    states = count_rows("n") + count_values("v", "nv") + sum_of("v", "s") + min_of("v", "lo") + max_of("v", "hi") + mean_of("v", "m") + approx_distinct("v", "d")
    got = {r["k"]: r for r in tree_aggregate(df, ["k"], states, chunk, fan).collect()}
    want = defaultdict(list)
    for k, v in data:
        want[k].append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        held = [v for v in vs if v is not None]
        r = got[k]
        assert (r["n"], r["nv"], r["s"], r["lo"], r["hi"], r["d"]) == (len(vs), len(held), sum(held), min(held), max(held), len(set(held)))
        assert r["m"] == pytest.approx(sum(held) / len(held))


def test_edges(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert tree_aggregate(empty, ["k"], count_rows() + mean_of("v", "m")).collect() == []
    only_null = spark.createDataFrame([("a", None), ("a", None)], "k string, v int")
    r = tree_aggregate(only_null, ["k"], count_rows() + sum_of("v", "s") + mean_of("v", "m")).first()
    assert (r["n_rows"], r["s"], r["m"]) == (2, None, None)
    # clashing and unneeded columns do no harm
    clash = spark.createDataFrame([("a", 1, 9), ("a", 2, 9)], "k string, v int, n_rows int")
    assert tree_aggregate(clash, ["k"], count_rows()).collect() == [("a", 2)]


def test_frequent_keys(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 5 + [("c",)] * 4 + [(None,)] * 41, "k string")
    assert {r[0] for r in frequent_keys(df, "k").select("k").collect()} == {"a", "b"}
    assert frequent_keys(spark.createDataFrame([], "k string"), "k").collect() == []


@pytest.mark.parametrize("rows,rounds", [(4096, 6), (256, 4), (3, 1)])
def test_depth_follows_the_number_of_chunks(spark, rows, rounds):
    """Each round merges four neighbours: 4096, 1024, 256, 64, 16, 4 and one node."""
    df = spark.range(0, rows, 1, min(rows, 64)).selectExpr("'hot' AS k")
    plan = tree_aggregate(df, ["k"], count_rows(), chunk_rows=1, fan_in=4)
    assert plan.first()["n_rows"] == rows
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == rounds + 1  # one numbers the chunks
