import random
from collections import Counter, defaultdict

import pytest

from pairloom.llm.packing import default_vocabulary, pack, pack_plan, token_counts


def test_plan_uses_every_item_once_and_keeps_the_capacity():
    for seed in range(300):
        rng = random.Random(seed)
        cap = rng.choice([1, 5, 10, 64, 100])
        hist = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        used = Counter()
        for content, many in pack_plan(hist, cap):
            assert sum(content) <= cap and many > 0
            for n in content:
                used[n] += many
        assert used == Counter(hist)


def test_exact_complements_leave_no_room():
    assert sorted(pack_plan({6: 3, 4: 3, 5: 2, 2: 1, 3: 2}, 10)) == sorted([((6, 4), 3), ((5, 5), 1), ((3, 3, 2), 1)])
    assert pack_plan({7: 10, 2: 10, 1: 10}, 10) == [((7, 2, 1), 10)]
    hist = {n: 5 for n in range(1, 101)}
    waste = sum(100 * m for _, m in pack_plan(hist, 100)) - sum(n * c for n, c in hist.items())
    assert waste < 100


def test_pack(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choices(["слово", "word", "и", "12"], k=rng.choice([3, 3, 3, rng.randint(0, 200)]))), 1) for i in range(400)]
    data += [(1000, None, 1), (1001, "", 1), (1002, "очень длинный текст " * 2000, 1), (5, "copy of an id", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, len int").drop("len")
    counts = sorted(map(tuple, token_counts(df, "doc_id", "text", default_vocabulary()).collect()))
    out = pack(df, "doc_id", "text", capacity=256).collect()
    room, pieces = Counter(), defaultdict(list)
    for r in out:
        if r["n_tokens"]:
            room[r["container"]] += r["n_tokens"]
        else:
            assert r["container"] is None
        pieces[r["id"]].append((r["start_token"], r["n_tokens"]))
    assert max(room.values()) <= 256 and sorted(room) == list(range(len(room)))
    total = Counter()
    for i, n in counts:
        total[i] += n
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == dict(total)
    for i, n in counts:
        if i != 5:
            assert sorted(pieces[i]) == [(s, min(256, n - s)) for s in range(0, max(n, 1), 256)]
    assert sum(room.values()) > 0.98 * 256 * (len(room) - 1)
    assert pack(df.where("doc_id < 0"), "doc_id", "text").collect() == []


def test_unknown_vocabulary_fails(spark):
    with pytest.raises(Exception):
        token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", "/nonexistent").collect()
