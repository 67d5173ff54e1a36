"""Folds by one rule at every size, for every labelled row."""

import math
import random
import statistics

import pytest

from pairloom.operators.evaluation import group_folds, place_alike


def test_one_rule_at_every_size(spark):
    rng = random.Random(3)
    rows = [(g, int(rng.random() < 0.2)) for g in range(60) for _ in range(rng.randint(1, 6))] + [(g, int(g % 3 == 0)) for g in range(100, 400)] + [(99, 0)] * 3000 + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "g long, y int")
    for strat in (True, False):
        small, large = (sorted(map(tuple, group_folds(df, "g", "y", 5, strat, limit).collect()), key=str) for limit in (100_000, 10))
        assert small == large and {g for g, _ in small} == {g for g, _ in rows}


def greedy(shapes, k, stratified):
    """The rule group by group."""
    whole = [max(sum(s[c] * s[3] for s in shapes), 1) for c in (0, 1)]
    held, size, out = [[0, 0] for _ in range(k)], [0] * k, [[0] * k for _ in shapes]
    for i in sorted(range(len(shapes)), key=lambda i: ((-abs(shapes[i][0] - shapes[i][1]) if stratified else 0), -shapes[i][2], shapes[i])):
        for _ in range(shapes[i][3]):

            def cost(f):
                with_it = [[(h[c] + shapes[i][c] * (g == f)) / whole[c] for g, h in enumerate(held)] for c in (0, 1)]
                return round(sum(map(statistics.pstdev, with_it)) / 2, 12) if stratified else 0

            f = min(range(k), key=lambda f: (cost(f), size[f], f))
            out[i][f] += 1
            size[f] += shapes[i][2]
            held[f] = [held[f][c] + shapes[i][c] for c in (0, 1)]
    return out


@pytest.mark.parametrize("stratified", [True, False])
def test_whole_rounds_are_the_greedy_choice(stratified):
    rng = random.Random(5)
    for _ in range(15):
        seen = {(rng.randint(0, 9), rng.randint(0, 4)): rng.choice((1, 2, 7, 40)) for _ in range(8)} | {(300, 0): 1}
        shapes = [(a, b, a + b, m) for (a, b), m in seen.items() if a + b]
        assert place_alike(shapes, 4, stratified) == greedy(shapes, 4, stratified)


def test_very_many_groups_take_few_steps():
    placed = place_alike([(1, 0, 1, 10**12), (3, 1, 4, 10**12 + 1), (500, 2, 502, 3)], 5, True)
    assert [sum(p) for p in placed] == [10**12, 10**12 + 1, 3] and math.isclose(max(placed[0]), min(placed[0]), rel_tol=1e-6)
