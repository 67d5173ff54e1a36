"""Labelled rows without a group are folded and scored like the others."""

import pytest

from pairloom.operators.learners import out_of_fold
from pairloom.plans import registry

# record, other record, group, label
ROWS = [(f"a{i}", f"b{i}", i // 3, i % 2) for i in range(18)] + [("n1", "n2", None, 0), ("n2", "n1", None, 1), ("n3", "n4", None, 1), ("m1", "m2", -1, 0), ("z", "y", 1, None), ("z", "y", 1, 2)]
LABELLED = [r for r in ROWS if r[3] in (0, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("folds")
    rows = [(*r, f"red {r[0]}", f"blue {r[1]} {r[3]}", "c") for r in ROWS]
    spark.createDataFrame(rows, "variantid_1 string, variantid_2 string, group_id long, is_double int, name_1 string, name_2 string, unique_cat_1 string").write.parquet(f"{d}/train_df.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["stratified_group_kfold", "group_kfold"])
def test_every_unit_has_a_fold(spark, folder, name):
    got = [tuple(r) for r in registry.queries()[name](spark, folder).select("group_id", "unit").collect()]
    want = {(g, f"g{g}") for *_, g, _ in LABELLED if g not in (None, -1)} | {(None, "pair|n1|n2"), (None, "pair|n3|n4"), (None, "pair|m1|m2")}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["bow_classifier", "per_category_model"])
def test_every_labelled_row_is_scored(spark, folder, name):
    got = registry.queries()[name](spark, folder).collect()
    assert sorted((r["variantid_1"], r["variantid_2"], r["is_double"]) for r in got) == sorted((a, b, y) for a, b, _, y in LABELLED)
    assert all(0 < r["score"] < 1 for r in got)
    assert len({r["fold"] for r in got if {r["variantid_1"], r["variantid_2"]} == {"n1", "n2"}}) == 1


def test_null_groups_meet_their_fold(spark):
    df = spark.createDataFrame([(g, y, ["w"]) for g in (1, 2, None) for y in (0, 1)], "g long, is_double int, tokens array<string>")
    folds = spark.createDataFrame([(1, 0), (2, 1), (None, 0)], "g long, fold int")
    assert sorted((r["g"] or 0, r["fold"]) for r in out_of_fold(df, folds, "g").collect()) == [(0, 0)] * 2 + [(1, 0)] * 2 + [(2, 1)] * 2
