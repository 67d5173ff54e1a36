"""All queries of the library and the SQL of those that SQL can express."""

from __future__ import annotations

from pairloom.plans import attributes, core, features, flagship as top, models, reshape, scans, table, texts


def _parts():
    yield core.QUERIES, core.SQL
    for module in (top, scans, reshape, texts, attributes, features, models, table):
        yield module.R.queries, module.R.sql


def queries() -> dict:
    return {k: q for found, _ in _parts() for k, q in found.items()}


def oracle_sql() -> dict:
    return {k: s for _, found in _parts() for k, s in found.items()}


def flagship(spark, sf_dir):
    return top.likely_duplicates(spark, sf_dir)
