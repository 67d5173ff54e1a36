import random

from pairloom.llm.splits import assign_splits, tied_groups

SCHEMA = "a string, b string, g long, y int, unit string"


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(3000):
        g = 7 if rng.random() < 0.1 else rng.choice([None, -1]) if rng.random() < 0.02 else rng.randint(100, 500)
        out.append((f"x{rng.randint(0, 9000)}", f"x{rng.randint(0, 9000)}", g, rng.choice([0, 0, 0, 0, 1, -1]), "mine"))
    out += [out[0], (out[1][1], out[1][0], *out[1][2:]), (None, "x1", 100, 1, "mine"), ("x1", "x1", 101, 1, "mine")]
    return out


def brute(data):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    at = {}
    for a, b, g, y, _ in data:
        if y == 1 and g not in (None, -1):
            for x in (a, b):
                if x is not None:
                    at.setdefault(x, set()).add(g)
    for gs in at.values():
        gs = sorted(gs)
        for g in gs[1:]:
            p, q = find(gs[0]), find(g)
            up[max(p, q)] = min(p, q)
    return {g: find(g) for g in list(up)}


def test_ties_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data)
    sizes = {}
    for u in want.values():
        sizes[u] = sizes.get(u, 0) + 1
    got = dict(map(tuple, tied_groups(df, "g", "y", "a", "b").collect()))
    assert got == {g: u for g, u in want.items() if sizes[u] > 1}


def test_splits(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA).withColumnRenamed("unit", "other")
    out = assign_splits(df, "g", "y", "a", "b", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    labelled = [r for r in data if r[3] in (0, 1)]
    assert len(out) == len(labelled)
    want = brute(data)
    place = {}
    for r in out:
        assert r["split"] in ("train", "validation", "test")
        if r["g"] not in (None, -1):
            assert place.setdefault(want.get(r["g"], r["g"]), r["split"]) == r["split"]
        else:
            assert place.setdefault((min(r["a"], r["b"]), max(r["a"], r["b"])), r["split"]) == r["split"]
    rate = sum(r[3] for r in labelled) / len(labelled)
    for k, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        part = [r["y"] for r in out if r["split"] == k]
        assert abs(len(part) / len(out) - share) < 0.03
        assert abs(sum(part) / len(part) - rate) < 0.05


def test_one_group_with_nearly_all_rows_and_empty(spark):
    df = spark.createDataFrame([(f"a{i}", f"b{i}", 1, i % 2, "u") for i in range(300)] + [(f"c{i}", f"d{i}", i + 2, i % 2, "u") for i in range(30)], SCHEMA).drop("unit")
    out = assign_splits(df, "g", "y", "a", "b", {"train": 0.8, "test": 0.2}).collect()
    assert len(out) == 330 and {r["split"] for r in out if r["g"] == 1} == {"train"}
    empty = spark.createDataFrame([], SCHEMA).drop("unit")
    assert assign_splits(empty, "g", "y", "a", "b", {"train": 1.0}).collect() == []
    assert tied_groups(empty, "g", "y", "a", "b").collect() == []
