"""The attribute queries over whole tables: nested, empty, broken and missing texts keep their rows."""

import json

import pytest

from pairloom.plans import registry

NESTED = json.dumps({"a": "1", "b": {"c": 2, "d": ["x", "y"]}, "e": [{"f": "u"}, {"g": "v"}]})
ROWS = [
    ("p", "q", NESTED, json.dumps({"a": "1", "b": {"c": 3}, "g": "v"})),
    ("r", "s", "{}", NESTED),
    ("t", "u", "{cut", '{"a": "1"}'),
    ("v", "w", None, '{"a": "1"}'),
    ("x", "y", '{"a": "12"}', '{"a": "21"}'),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("attrs")
    js = "characteristic_attributes_mapping"
    spark.createDataFrame(ROWS, f"variantid_1 string, variantid_2 string, {js}_1 string, {js}_2 string").write.parquet(f"{d}/train_df.parquet")
    return str(d)


def rows(spark, folder, name):
    return [tuple(r) for r in registry.queries()[name](spark, folder).collect()]


def test_flatten(spark, folder):
    got = dict(rows(spark, folder, "flatten_attrs"))
    assert got[NESTED] == "a=1|c=2|d=x,y|f=u|g=v"
    assert set(got) == {t for r in ROWS for t in r[2:]} and got["{cut"] is None and got[None] is None and got["{}"] == ""


def test_keyval(spark, folder):
    got = {r[0]: r[2] for r in rows(spark, folder, "concat_keyval")}  # the first side
    assert got == {"p": "a=1 c=2 d=x,y f=u g=v", "r": "", "t": None, "v": None, "x": "a=12"}


def test_equal_share(spark, folder):
    got = {r[0]: r[2] for r in rows(spark, folder, "attrs_fully_eq")}
    assert got == {"p": pytest.approx(2 / 3, abs=1e-6), "r": None, "t": None, "v": None, "x": 1.0}
