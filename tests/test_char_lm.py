"""The character model against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from pairloom.operators.char_lm import gram_counts, perplexity
from pairloom.scratch import Scratch


def letters(t):
    return " ".join(re.findall("[a-zа-я]+", t.lower()))


def brute_counts(texts, order=5):
    c = Counter()
    for t in texts:
        s = letters(t or "")
        c.update(s[i : i + k] for i in range(len(s)) for k in range(1, order + 1) if i + k <= len(s))
    return c


def brute_perplexity(t, c, order=5):
    s, total = letters(t), sum(n for g, n in c.items() if len(g) == 1)
    if not s:
        return None
    lp = 0.0
    for i in range(len(s)):
        w = s[max(0, i - order + 1) : i + 1]
        k = next((k for k in range(len(w), 0, -1) if c[w[-k:]]), 0)
        lp += math.log(c[w[-k:]] / (c[w[-k:-1]] if k > 1 else total) * 0.4 ** (len(w) - k) if k else 1 / (total + 1))
    return math.exp(-lp / len(s))


def test_counts_and_perplexity(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("абвabc 1,") for _ in range(n)) for n in (0, 1, 3, 50, 199, 200, 201, 204, 205, 900)] + [None, "", "!!!"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, gram int")
    counts = gram_counts(df, "text")
    want = brute_counts(texts)
    assert {r["gram"]: r["n"] for r in counts.collect()} == want
    asked = ["абв abc", "zzz", "абв абв абв", "", "...", None, "абв abc"]
    got = {r["text"]: r["perplexity"] for r in perplexity(spark.createDataFrame([(t,) for t in asked], "text string"), "text", counts, Scratch(spark, "t")).collect()}
    assert set(got) == set(asked) - {None}
    for t, p in got.items():
        assert p == (None if letters(t) == "" else pytest.approx(brute_perplexity(t, want)))
    assert gram_counts(df.where("gram > 1"), "text").collect() == []
