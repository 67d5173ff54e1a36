"""Global ranks without a global window: range partitions plus offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import Scratch


def running_totals(df: DataFrame, scratch: Scratch, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, the total over all rows that come before.

    Rows are range-partitioned by ``by`` and ``order`` and staged with their
    partition number; each partition adds up its own rows, and the totals of
    all earlier partitions (one row per partition and ``by``) are broadcast as
    offsets. ``order`` should be a total order; equal rows come in any order.
    Empty input gives no rows.
    """
    by = by or []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumns({f"__v{i}": c.cast("long") for i, c in enumerate(sums.values())})
    staged = scratch.save(held.repartitionByRange(n, *[F.col(c).asc() for c in by], *order).withColumn("__part", F.spark_partition_id()))
    vs = [f"__v{i}" for i in range(len(sums))]
    totals = staged.groupBy(*by, "__part").agg(*[F.sum(v).alias(v) for v in vs])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}o") for v in vs])
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in vs})
    # one row per partition and value of ``by``: at most n plus the number of those
    out = local.join(F.broadcast(offsets), [*by, "__part"])
    return out.withColumns({name: F.col(f"{v}o") + F.col(f"{v}i") for name, v in zip(sums, vs)}).drop("__part", *vs, *[f"{v}o" for v in vs], *[f"{v}i" for v in vs])


def global_rank(df: DataFrame, scratch: Scratch, order: list[Column], rank: str, by: list[str] | None = None, weight: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``: 1 plus the weight (1 where not given) of all rows that come before."""
    w = weight if weight is not None else F.lit(1)
    return running_totals(df, scratch, order, {rank: w}, by, partitions).withColumn(rank, F.col(rank) + 1)
