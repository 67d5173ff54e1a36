"""The SQL of this subpackage's queries against DuckDB, and invariants of those without."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import compare
from pairloom.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


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


def test_every_listing_has_one_product(spark, con):
    got = [r["variantid_1"] for r in QUERIES["p4_products"](spark, str(DATA)).collect()]
    assert sorted(got) == [r[0] for r in con.execute("SELECT DISTINCT variantid_1 FROM train_df ORDER BY 1").fetchall()]


def test_clean_corpus_is_the_rest(spark, con):
    bad = {r[0] for r in QUERIES["p10_found"](spark, str(DATA)).collect()}
    clean = [r["doc_id"] for r in QUERIES["p10_clean"](spark, str(DATA)).collect()]
    ids = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    assert set(clean) == ids - bad and len(clean) == len(set(clean))
