"""Similarities over many pairs at once against the scalar ones, and the feature table's jobs."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pairloom.functions import edit as E
from pairloom.functions import lanes as L

DATA = Path("/root/testdata/sf0.001")


def _texts(n=800, seed=3):
    rnd = random.Random(seed)
    word = lambda most, letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
    xs, ys = ["", "a", "", "x" * 1100, "ab" * 600], ["", "", "b", "x" * 1100 + "y", "ba" * 30]
    for _ in range(n):
        letters = rnd.choice(["ab ", "абвг дe", "abcdefgh  ijк\U0001f600"])
        x = word(rnd.choice([5, 40, 150]), letters)
        xs.append(x)
        ys.append(word(40, letters) if rnd.random() < 0.5 else "".join(c for c in x if rnd.random() < 0.85) + word(4, letters))
    return xs, ys


@pytest.mark.parametrize(
    "many,scalar",
    [
        (L.lcs_lengths, E.lcs_length),
        (L.jaro_winklers, E.jaro_winkler),
        (L.damerau_levenshteins, E.damerau_levenshtein),
        (L.shared_letters, lambda a, b: sum((Counter(a) & Counter(b)).values())),
        (lambda a, b: L.similarities(a, b, True)["token_sort"], E.token_sort),
        (lambda a, b: L.similarities(a, b, True)["token_set"], E.token_set),
        (lambda a, b: L.similarities(a, b, True)["wratio"], E.weighted),
        (lambda a, b: L.similarities(a, b, True)["subsequence"], E.lcs_share),
    ],
)
def test_same_as_scalar(many, scalar):
    xs, ys = _texts()
    assert list(many(xs, ys)) == [scalar(x, y) for x, y in zip(xs, ys)]


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 10)
    monkeypatch.setattr(L, "LANES", 64)
    xs, ys = _texts(300)
    assert list(L.lcs_lengths(xs, ys)) == [E.lcs_length(x, y) for x, y in zip(xs, ys)]
    assert list(L.damerau_levenshteins(xs, ys)) == [E.damerau_levenshtein(x, y) for x, y in zip(xs, ys)]


def test_ngrams():
    xs, ys = _texts()
    xs.append("".join(map(chr, range(0x4E00, 0x8E00))))  # so many letters that numbers cannot be packed
    ys.append(xs[-1][100:])
    for n, got in enumerate(L.ngram_ious(xs, ys, 7), 1):
        grams = lambda t: {t[i : i + n] for i in range(len(t) - n + 1)}  # noqa: B023, E731
        want = [len(grams(x) & grams(y)) / len(grams(x) | grams(y)) if grams(x) | grams(y) else 0.0 for x, y in zip(xs, ys)]
        assert np.array_equal(got, want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pairs_are_not_staged_by_family(spark, monkeypatch):
    """Families of features were each written and joined: 12 stages of all pairs beside the pairs themselves."""
    from pairloom.plans import table
    from pairloom.scratch import Scratch

    kept, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *a: kept.append(df.columns) or save(self, df, *a))
    df = table.pair_features(spark, str(DATA))
    assert len(df.columns) == 446
    assert [c for c in kept if "variantid_1" in c] == [["variantid_1", "variantid_2"]]
