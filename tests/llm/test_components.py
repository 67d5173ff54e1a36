import random

import pytest

from pairloom.llm.components import frontier_components, link_groups, links, peeled_components, propagate_minimum
from pairloom.scratch import Scratch


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def graphs():
    rng = random.Random(4)
    name = lambda i: f"{i:05d}"
    chain = [(name(i), name(i + 1)) for i in range(24)]
    shuffled = [(name((i * 7) % 41), name(((i + 1) * 7) % 41)) for i in range(40)]
    star = [("hub", name(i)) for i in range(60)]
    loose = [(name(rng.randint(0, 400)), name(rng.randint(0, 400))) for _ in range(180)]
    odd = [("a", "a"), (None, "b"), ("c", None), ("d", "e"), ("e", "d"), ("d", "e")]
    return {"chain": chain, "shuffled": shuffled, "star": star, "loose": loose, "odd": odd, "mixed": star + [(f"m{a}", f"m{b}") for a, b in chain + loose], "none": []}


@pytest.mark.parametrize("kind", list(graphs()))
def test_all_methods_agree_with_union_find(spark, kind):
    edges = graphs()[kind]
    df = spark.createDataFrame(edges, "x string, y string")
    want = brute(edges)
    s = Scratch(spark, "t")
    for r in (30, 1) if kind == "chain" else (1,) if kind == "mixed" else (30,):
        assert dict(map(tuple, link_groups(df, "x", "y", r).collect())) == want
    if kind in ("mixed", "odd", "none"):
        assert dict(map(tuple, frontier_components(links(df, "x", "y"), s).collect())) == want
    if kind in ("loose", "none"):
        assert dict(map(tuple, propagate_minimum(links(df, "x", "y"), s).collect())) == want


def test_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([("1", "2", "q"), ("2", "1", "q"), ("1", "2", "q")], "x string, y string, label string")
    assert dict(map(tuple, link_groups(df, "x", "y").collect())) == {"1": "1", "2": "1"}
    assert peeled_components(links(df, "x", "y"), Scratch(spark, "t")).columns == ["id", "label"]
