"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.sources.tables import table

IDS = ["variantid_1", "variantid_2"]


def pairs(spark, d: str) -> DataFrame:
    return table(spark, d, "train_df")


def r6(c: Column) -> Column:
    return F.round(c, 6)


class Registry:
    """Queries of one module by name, with their SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep
