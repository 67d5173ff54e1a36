"""Per-key aggregation by a multi-level tree, for keys that hold most rows.

Level 0 folds fixed-size chunks of the input where they lie. Each further
level merges the states of ``fan_in`` neighbouring nodes, so no reducer ever
receives all the partial states of a key: at most ``fan_in`` at each level,
however many rows the key has. The number of levels is the logarithm of the
number of chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import Scratch


@dataclass(frozen=True)
class State:
    """One mergeable aggregate: how to start, how to merge, how to read it."""

    name: str
    init: Column
    merge: str = "sum"
    final: object = field(default=None)


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "hll": F.hll_union_agg}


def count_rows(name: str = "n_rows") -> list[State]:
    return [State(name, F.count(F.lit(1)))]


def count_values(col: str, name: str) -> list[State]:
    return [State(name, F.count(col))]


def sum_of(col: str, name: str) -> list[State]:
    return [State(name, F.sum(col))]


def min_of(col: str, name: str) -> list[State]:
    return [State(name, F.min(col), "min")]


def max_of(col: str, name: str) -> list[State]:
    return [State(name, F.max(col), "max")]


def mean_of(col: str, name: str) -> list[State]:
    """Mean over non-null values; null where a key has none."""
    s, n = f"__{name}_s", f"__{name}_n"
    return [
        State(s, F.sum(col)),
        State(n, F.count(col)),
        State(name, None, final=lambda: F.try_divide(F.col(s), F.col(n))),
    ]


def approx_distinct(col: str, name: str, lg_k: int = 14) -> list[State]:
    """HyperLogLog sketch states; about 0.8 % standard error at ``lg_k`` 14."""
    s = f"__{name}_h"
    return [
        State(s, F.hll_sketch_agg(col, F.lit(lg_k)), "hll"),
        State(name, None, final=lambda: F.hll_sketch_estimate(s)),
    ]


def tree_aggregate(df: DataFrame, keys: list[str], states: list[State], chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """``keys`` and one column per state, one row per distinct key.

    Leaves are chunks of ``chunk_rows`` consecutive rows of an input partition,
    folded by their own task and staged. They are numbered through all
    partitions, and each round merges ``fan_in`` neighbours, until one node is
    left. A null key forms its own group. Empty input gives no rows, and a key
    whose values are all null gives null sums, minima and maxima. Columns of
    ``df`` that are not named are not read.
    """
    held = [s for s in states if s.init is not None]
    # upper 31 bits: partition, lower 33: row in it
    row = F.monotonically_increasing_id()
    chunked = df.withColumn("__row", row).withColumn("__part", F.shiftright("__row", 33)).withColumn("__chunk", F.floor(F.col("__row").bitwiseAND((1 << 33) - 1) / chunk_rows))
    leaves = Scratch(df.sparkSession, "tree").save(chunked.groupBy(*keys, "__part", "__chunk").agg(*[s.init.alias(s.name) for s in held]))
    # one row per input partition
    sizes = leaves.groupBy("__part").agg((F.max("__chunk") + 1).alias("__chunks"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__chunks").over(before), F.lit(0)).alias("__first"))
    n = sizes.agg(F.sum("__chunks")).first()[0] or 0
    out = leaves.join(F.broadcast(offsets), "__part").withColumn("__node", F.col("__first") + F.col("__chunk"))
    merged = [_MERGE[s.merge](s.name).alias(s.name) for s in held]
    while n > fan_in:
        n = -(-n // fan_in)
        out = out.withColumn("__node", F.floor(F.col("__node") / fan_in)).groupBy(*keys, "__node").agg(*merged)
    out = out.groupBy(*keys).agg(*merged)
    cols = [s.final().alias(s.name) if s.final else F.col(s.name) for s in states if not s.name.startswith("__")]
    return out.select(*keys, *cols)


def frequent_keys(df: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """Keys that hold at least ``percent`` % of all rows, with their counts.

    Rows with a null key count towards the total but are no key. The total is
    the sum over the aggregated keys, read as a scalar subquery of one row.
    """
    counts = tree_aggregate(df.select(key), [key], count_rows())
    total = counts.agg(F.sum("n_rows").alias("t")).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= total * percent))
