"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import frontier_components, links
from pairloom.operators.skew import salted_lookup
from pairloom.scratch import Scratch

BUCKETS = 1024  # hash cells per stratum
HEAVY = 200  # a unit is heavy from 1/HEAVY of all rows on: at most HEAVY of them
STRATA = 11  # label rate 0, and tenths above it


def tied_groups(df: DataFrame, group: str, label: str, a: str, b: str, none: tuple = (-1,)) -> DataFrame:
    """``(group, unit)`` of each group tied to another; ``unit`` is the least group tied with it.

    Two groups are tied when one record, in ``a`` or ``b``, stands in rows of
    both with ``label`` 1; ties carry on. Null groups and those in ``none`` are
    no groups; null records tie nothing. A record ties all its groups to the
    least of them (a star, not all pairs), so a record in very many groups adds
    one edge for each.
    """
    scratch = Scratch(df.sparkSession, "ties")
    rows = df.where((F.col(label) == 1) & F.col(group).isNotNull() & ~F.col(group).isin(*none))
    stands = rows.select(F.explode(F.array(a, b)).alias("record"), F.col(group).alias("g")).where("record IS NOT NULL").distinct()
    stands = scratch.save(stands)
    least = stands.groupBy("record").agg(F.min("g").alias("m"), F.max("g").alias("x")).where("m < x").select("record", "m")
    # a record may stand in very many groups
    star = salted_lookup(stands, least, ["record"], F.col("g")).where("g <> m").select("g", "m")
    found = frontier_components(links(star, "g", "m"), scratch)
    return found.select(F.col("id").alias("group"), F.col("label").alias("unit"))


def _cell(unit: Column) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(BUCKETS)).cast("int")


def assign_splits(df: DataFrame, group: str, label: str, a: str, b: str, shares: dict[str, float], none: tuple = (-1,)) -> DataFrame:
    """Rows with ``label`` 0 or 1, with ``unit`` and ``split``.

    A unit is a group with all groups tied to it (``tied_groups``); a row
    without group is a unit with all rows of the same two records in any order.
    Units are cut into splits by the order of their hash, apart for each tenth
    of label rate, so that row shares and label rates both come out near
    ``shares``. Units with at least 1/200 of all rows (at most 200) are placed
    first, each where most is missing; the hash cuts fill up the rest. The
    driver sees those and 11 x 1024 cell sums, whatever the input's size. A
    split with share 0 gets no hash cell. Empty input gives no rows.
    """
    total_share = sum(shares.values())
    shares = {k: v / total_share for k, v in shares.items()}
    rows = df.where(F.col(label).isin(0, 1))
    ties = tied_groups(df, group, label, a, b, none).select(F.col("group").alias(group), F.col("unit").alias("__unit"))
    is_group = F.col(group).isNotNull() & ~F.col(group).isin(*none)
    pair = F.concat_ws("|", F.lit("pair"), F.least(a, b), F.greatest(a, b))
    unit = F.when(is_group, F.concat(F.lit("g"), F.coalesce("__unit", group).cast("string"))).otherwise(pair)
    # a group may hold very many rows, and a unit more
    scratch = Scratch(df.sparkSession, "units")
    rows = scratch.save(salted_lookup(rows, ties, [group], F.concat_ws("|", a, b), "left").withColumn("unit", unit).drop("__unit"))
    units = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    units = scratch.save(units.withColumn("stratum", F.ceil(F.col("p") * (STRATA - 1) / F.col("n")).cast("int")).withColumn("cell", _cell(F.col("unit"))))
    total = units.agg(F.sum("n"), F.sum("p")).first()
    n_all, p_all = total[0] or 0, total[1] or 0
    heavy = units.where(F.col("n") * HEAVY >= n_all).select("unit", "n", "p").collect()
    cells = units.where(F.col("n") * HEAVY < n_all).groupBy("stratum", "cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    placed, cuts = _plan([tuple(r) for r in heavy], [tuple(r) for r in cells], n_all, p_all, shares)
    spark = df.sparkSession
    chosen = spark.createDataFrame(list(placed.items()) or [(None, None)], "unit string, __s string")
    cut = spark.createDataFrame([(s, c, k) for (s, c), k in cuts.items()] or [(None, None, None)], "stratum int, cell int, __c string")
    # chosen: at most HEAVY rows; cut: at most STRATA x BUCKETS rows
    by_unit = units.join(F.broadcast(chosen), "unit", "left").join(F.broadcast(cut), ["stratum", "cell"], "left").select("unit", F.coalesce("__s", "__c").alias("split"))
    return salted_lookup(rows, by_unit, ["unit"], F.concat_ws("|", a, b))


def _plan(heavy: list[tuple], cells: list[tuple], n_all: int, p_all: int, shares: dict[str, float]) -> tuple[dict, dict]:
    """Split of each heavy unit and of each (stratum, cell)."""
    missing = {k: [v * n_all, v * p_all] for k, v in shares.items()}

    def lack(k: str, n: int, p: int) -> float:
        """How far the split would still be from its share of rows and of labels."""
        rows, pos = missing[k]
        return (rows - n) / max(n_all, 1) + (pos - p) / max(p_all, 1)

    placed = {}
    for unit, n, p in sorted(heavy, key=lambda r: (-r[1], r[0])):
        k = max(shares, key=lambda k: (lack(k, n, p), shares[k]))
        placed[unit] = k
        missing[k][0] -= n
        missing[k][1] -= p
    want = {k: max(m[0], 0.0) for k, m in missing.items()}
    scale = sum(want.values()) or 1.0
    part = {k: w / scale for k, w in want.items()}
    cuts: dict = {}
    carry = dict.fromkeys(shares, 0.0)  # what rounding to whole cells left over, carried to the next stratum
    for stratum in sorted({c[0] for c in cells}):
        own = sorted(c for c in cells if c[0] == stratum)
        n_own = sum(c[2] for c in own)
        goal = {k: part[k] * n_own + carry[k] for k in shares}
        got = dict.fromkeys(shares, 0)
        order = [k for k in sorted(shares, key=lambda k: (shares[k], k)) if part[k] > 0] or list(shares)[:1]
        i = 0
        for _, cell, n, _p in own:
            while i < len(order) - 1 and got[order[i]] + n / 2 > goal[order[i]]:
                i += 1
            cuts[stratum, cell] = order[i]
            got[order[i]] += n
        for k in shares:
            carry[k] = goal[k] - got[k]
    return placed, cuts
