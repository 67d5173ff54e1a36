"""Every query with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import compare
from pairloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(compare.cell(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert Counter(tuple(map(compare.cell, r)) for r in df.select(*cols).collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"bow_classifier", "per_category_model"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
