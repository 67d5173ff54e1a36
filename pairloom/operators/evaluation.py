"""Evaluation of scores against labels, and group-aware folds."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import global_rank, running_totals
from pairloom.operators.skew import salted_join
from pairloom.scratch import Scratch


def pr_points(df: DataFrame, score: str, label: str, scratch: Scratch) -> DataFrame:
    """Precision and recall at each distinct score from the highest, with the point before.

    Null scores or labels are left out. The curve starts at recall 0 and
    precision 1. Without positives recall is null.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(per, scratch, [F.desc("s")], {"p0": F.col("p"), "n0": F.col("n")})
    pos = per.agg(F.sum("p")).scalar()
    tp, n = F.col("p0") + F.col("p"), F.col("n0") + F.col("n")
    return cum.select(
        "s",
        (tp / n).alias("precision"),
        F.try_divide(tp.cast("double"), pos).alias("recall"),
        F.when(F.col("n0") == 0, 1.0).otherwise(F.try_divide(F.col("p0").cast("double"), F.col("n0"))).alias("precision0"),
        F.try_divide(F.col("p0").cast("double"), pos).alias("recall0"),
    )


def pr_auc(points: DataFrame) -> DataFrame:
    """One row: area by trapezoids and average precision by steps."""
    step = F.col("recall") - F.col("recall0")
    return points.agg(F.sum(step * (F.col("precision") + F.col("precision0")) / 2).alias("pr_auc"), F.sum(step * F.col("precision")).alias("average_precision"))


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, stratified: bool = True, exact_groups: int = 100_000) -> DataFrame:
    """``(group, fold)``: groups kept whole over ``k`` folds with like class counts (or like sizes).

    Greedy at every size: groups by falling spread of their class counts (or by
    size), then by size, each to the fold where the classes' spread over folds
    grows least, ties to the fold with fewer rows. Groups with the same counts
    are alike to the rule, so the driver places counts with their number of
    groups, and each fold takes its number of them in hash order. N rows of
    labels 0 and 1 have at most (3N)^(2/3) / 2 different counts. Null groups
    are one group. ``exact_groups`` has no effect any more.
    """
    scratch = Scratch(df.sparkSession, "folds")
    per = df.groupBy(group).agg(F.sum((F.col(label) == 0).cast("long")).alias("c0"), F.sum((F.col(label) == 1).cast("long")).alias("c1"), F.count(F.lit(1)).alias("n"))
    per = scratch.save(per.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("c0", "c1")}))
    by = ["c0", "c1", "n"] if stratified else ["n"]
    alike = per.groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    # one row per different count
    found = [r.asDict() for r in alike.collect()]
    shapes = [(r.get("c0", 0), r.get("c1", 0), r["n"], r["m"]) for r in found]
    placed = place_alike(shapes, k, stratified)
    rows = [(*[r[c] for c in by], r["m"], list(accumulate(p))) for r, p in zip(found, placed)]
    upto = df.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in [*by, "m"]) + ", upto array<long>")
    ranked = global_rank(per, scratch, [F.xxhash64(group).asc(), F.col(group).asc()], "rk", by=by)
    total = F.lit(max(sum(r["m"] for r in found), 1))
    out = salted_join(ranked, upto, by, "m", total, F.col("rk"))
    return out.select(group, F.size(F.filter("upto", lambda u: u < F.col("rk"))).alias("fold"))


def place_alike(shapes: list[tuple], k: int, stratified: bool) -> list[list[int]]:
    """For each ``(c0, c1, n, m)``, how many of its ``m`` like groups each of ``k`` folds takes.

    The greedy rule of ``group_folds``, group by group. Its choice depends on
    the folds' differences only, so once ``k`` like groups in a row have gone
    to ``k`` different folds the same round repeats, and whole rounds are
    placed at once.
    """
    whole = [max(sum(s[c] * s[3] for s in shapes), 1) for c in (0, 1)]
    order = sorted(range(len(shapes)), key=lambda i: ((-abs(shapes[i][0] - shapes[i][1]) if stratified else 0), -shapes[i][2], shapes[i]))
    held, size = [[0, 0] for _ in range(k)], [0] * k
    out = [[0] * k for _ in shapes]
    for i in order:
        *counts, n, left = shapes[i]
        recent: list[int] = []

        def place(f: int, times: int) -> None:
            out[i][f] += times
            size[f] += n * times
            for c in (0, 1):
                held[f][c] += counts[c] * times

        while left:
            if stratified:
                f = min((round(_spread(held, whole, counts, f), 12), size[f], f) for f in range(k))[2]
            else:
                f = min(range(k), key=lambda f: (size[f], f))
            place(f, 1)
            left -= 1
            recent = [*recent, f][-k:]
            if len(set(recent)) == k and left >= k:
                for g in range(k):
                    place(g, left // k)
                left %= k
    return out


def _spread(held: list[list[int]], whole: list[int], counts: list[int], f: int) -> float:
    """Mean over the classes of the standard deviation of their shares over folds, with ``counts`` in fold ``f``."""
    cost = 0.0
    for c in (0, 1):
        got = [h[c] for h in held]
        got[f] += counts[c]
        # whole numbers under the root: what all folds gain alike cancels exactly
        cost += math.sqrt(len(got) * sum(x * x for x in got) - sum(got) ** 2) / (len(got) * whole[c])
    return cost / 2
