import math
import random
import re
from collections import Counter, defaultdict

import pytest

from pairloom.llm.distinctive import concentrated_terms, term_weights

COLS = ["name", "text"]


def brute(rows):
    recs = {}
    for i, *fields in rows:
        if i is not None:
            t = " ".join(f or "" for f in fields[:2])
            recs[i] = min(recs.get(i, t), t)
    tf = {i: Counter(w.lower() for w in re.findall(r"[^\W_]{3,}", t)) for i, t in recs.items()}
    df, cf = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        cf.update(c)
    n = len(recs)
    return {(i, w): (k, df[w], k * (-math.log2(df[w] / n) + math.log2(1 - math.exp(-cf[w] / n)))) for i, c in tf.items() for w, k in c.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["общее"] * 40 + [f"слово{i}" for i in range(30)] + ["ab", "x_y", "Ёлка", "été"]
    rows = [(str(rng.randint(0, 40)), " ".join(rng.choices(vocab, k=rng.randint(0, 20))), rng.choice([None, "", "tail Tail TAIL"]), "x") for _ in range(200)]
    rows += [rows[0], (None, "lost words", None, "x"), ("long", "очень " * 30_000, None, "x")]
    # a column named like one of the operator's own does no harm
    df = spark.createDataFrame(rows, "id string, name string, text string, term string")
    want = brute(rows)
    got = {(r["id"], r["term"]): r for r in term_weights(df, "id", COLS).collect()}
    assert set(got) == set(want)
    for k, (tf, n, w) in want.items():
        assert (got[k]["tf"], got[k]["df"]) == (tf, n) and got[k]["weight"] == pytest.approx(w, abs=1e-9)
    found = {(r["id"], r["term"]) for r in concentrated_terms(df, "id", COLS).collect()}
    assert found == {k for k, (tf, n, _) in want.items() if tf >= 3 and 2 <= n <= 5}


def test_concentrated_terms_weigh_more_than_spread_ones(spark):
    rows = [(str(i), "всюду " + ("редкое " * 5 if i < 2 else "")) for i in range(50)]
    w = defaultdict(dict)
    for r in term_weights(spark.createDataFrame(rows, "id string, name string"), "id", ["name"]).collect():
        w[r["id"]][r["term"]] = r["weight"]
    assert w["0"]["редкое"] > 5 > 1 > w["0"]["всюду"]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, name string, text string")
    assert term_weights(df, "id", COLS).collect() == []
    assert concentrated_terms(spark.createDataFrame([("1", None, None)], "id string, name string, text string"), "id", COLS).collect() == []
