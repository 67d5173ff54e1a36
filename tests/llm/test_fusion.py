import math
import random

import pandas as pd
import pytest

from pairloom.llm.fusion import fuse_ranks, top_share

S = ["s1", "s2", "s3"]
SCHEMA = "a string, b string, s1 double, s2 double, s3 double, place int"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.gauss(0, 1)
        s = [x + rng.gauss(0, 1), math.exp(5 * x + rng.gauss(0, 1)), rng.choice([0.0, 0.0, x * 1e6])]
        s = [rng.choice([None, math.nan, math.inf]) if rng.random() < 0.06 else v for v in s]
        out.append((f"{rng.randint(0, 900):03d}", f"{rng.randint(0, 900):03d}", *s, 1))
    return out + out[:20] + [(b, a, *r) for a, b, *r in out[20:40]] + [(None, "1", 1.0, 1.0, 1.0, 1)]


def brute(data, c=0.1):
    usable = lambda v: v if v is not None and math.isfinite(v) else None
    best = {}
    for a, b, *s in data:
        if a is None or b is None:
            continue
        k = (min(a, b), max(a, b))
        old = best.get(k, [None] * 3)
        best[k] = [max((v for v in (o, usable(x)) if v is not None), default=None) for o, x in zip(old, s)]
    df = pd.DataFrame.from_dict(best, orient="index", columns=S).astype(float)
    rank, n = df.rank(ascending=False), df.notna().sum()
    fused = (n / (c * n + rank)).mean(axis=1).round(9)
    keep = df.notna().sum(axis=1) >= 2
    return len(best), sorted(((-f, *k) for k, f in fused[keep].items()))


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).drop("place")
    n, want = brute([r[:5] for r in data])
    got = sorted((r["place"], r["a"], r["b"], r["fused"]) for r in fuse_ranks(df, "a", "b", S).collect())
    assert [g[0] for g in got] == list(range(1, len(want) + 1))
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(-w[0], abs=1e-6)
    top = {(r["a"], r["b"]) for r in top_share(df, "a", "b", S).collect()}
    assert top == {(a, b) for _, a, b in want[: n // 50]}


def test_classic_form(spark):
    df = spark.createDataFrame([("1", "2", 0.9, 5.0, None), ("3", "4", 0.8, 9.0, None), ("5", "6", 0.1, 7.0, 1.0)], "a string, b string, s1 double, s2 double, s3 double")
    got = {r["a"]: r["fused"] for r in fuse_ranks(df, "a", "b", S, k=60).collect()}
    assert got == pytest.approx({"1": 1 / 61 + 1 / 63, "3": 1 / 62 + 1 / 61, "5": 1 / 63 + 1 / 62 + 1 / 61}, abs=1e-8)


def test_scale_does_not_matter(spark):
    data = [r[:5] for r in rows(100, 5)]
    df = spark.createDataFrame(data, "a string, b string, s1 double, s2 double, s3 double")
    scaled = df.selectExpr("a", "b", "s1 * 1000 - 5 AS s1", "s2", "exp(s3 / 1e6) AS s3")
    order = lambda d: [(r["a"], r["b"]) for r in fuse_ranks(d, "a", "b", S).orderBy("place").collect()]
    assert order(df) == order(scaled)


def test_edges(spark):
    empty = spark.createDataFrame([], "a string, b string, s1 double, s2 double, s3 double")
    assert fuse_ranks(empty, "a", "b", S).collect() == [] and top_share(empty, "a", "b", S).collect() == []
    tied = spark.createDataFrame([(str(i), "x", 1.0, 1.0, None) for i in range(10)], "a string, b string, s1 double, s2 double, s3 double")
    assert [r["a"] for r in fuse_ranks(tied, "a", "b", S).orderBy("place").collect()] == [str(i) for i in range(10)]
