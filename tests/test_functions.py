import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import attrs as A
from pairloom.functions import edit as E
from pairloom.functions import numbers as N
from pairloom.functions import retrieval as Q
from pairloom.functions import sets as S
from pairloom.functions import text as T
from pairloom.functions import vectors as V
from pairloom.functions.units import find_units
from pairloom.operators.blending import aligned, blend


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "fn,given,want",
    [
        (T.clean_html_emoji, "a<b>c</b>\nd", "ac d"),
        (T.clean_html_emoji, "x\U0001f600\U0001f680y", "xy"),
        (T.extract_mixed, "iPhone12 13 pro а52 x_1 128gb", "iPhone12 а52 128gb"),
        (T.extract_latin, "Étion cat", "cat"),
        (T.normalize_underscore, "Red-iPhone, 12!", "red_iphone_12"),
        (T.token_length, "", 1),
        (T.token_length, "a  b", 3),
        (T.token_length, None, None),
        (T.digit_tokens, "ab123 a1 2024", "ab123 2024"),
        (T.digit_tokens, None, ""),
        (T.mixed_script_pct, "кoт дом", 50.0),
        (T.mixed_script_pct, "", 0.0),
        (T.char_tokenize, "Ab c", "a b <space> c"),
        (T.layout_fix, "кoт cat", "кот cat"),
    ],
)
def test_text(spark, fn, given, want):
    assert one(spark, given, fn) == want


def test_units(spark):
    assert one(spark, "1,5 кг и 20x30х5, 100%", find_units) == ["1,5 кг", "20x30x5"]
    assert one(spark, None, find_units) == []
    assert one(spark, "256gbx", find_units) == []


def two(spark, a, b, fn, kind="string"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(fn(F.col("a"), F.col("b")).alias("x")).first()["x"]


def test_numbers(spark):
    left, right = (two(spark, 10.0, 4.0, lambda a, b, k=k: N.ratios(a, b)[k], "double") for k in (0, 1))
    assert (left, right) == (2.5, 0.4)
    assert two(spark, 10.0, 0.0, lambda a, b: N.ratios(a, b)[0], "double") is None
    assert two(spark, "a b", None, lambda a, b: N.word_count_ratios(a, b)[0]) == 0.0
    assert two(spark, 10.9, 7.2, N.abs_diff, "double") == 3 and two(spark, 10.9, 7.2, N.sq_diff, "double") == 9
    assert two(spark, None, 7.2, N.sq_diff, "double") is None
    assert int(two(spark, 6e9, 0.0, N.sq_diff, "double")) == N.U64_LIMIT
    assert [two(spark, a, b, N.fillness) for a, b in (("x", "y"), (None, None), ("x", None))] == ["both", "none", "only one"]


def test_sets(spark):
    kind = "array<string>"
    assert two(spark, ["a", "b"], ["b", "c"], S.jaccard, kind) == pytest.approx(1 / 3)
    assert two(spark, ["a", "b"], ["b", "c"], S.overlap, kind) == 0.5
    assert two(spark, [], [], S.jaccard, kind) == 0.0 == two(spark, [], [], S.overlap, kind)
    grams = lambda n: lambda a, b: S.ngram_iou(T.char_ngrams(a, n), T.char_ngrams(b, n))
    assert [round(two(spark, "abcd", "abce", grams(n)), 6) for n in (1, 2, 3, 5)] == [0.6, 0.5, 0.333333, 0.0]
    assert two(spark, "night", "nacht", S.dice) == pytest.approx(0.6)
    assert two(spark, "night", "nacht", S.tanimoto) == pytest.approx(math.log2(3 / 7))
    assert two(spark, "", "", S.dice) == 1.0 and two(spark, "a", "b", S.tanimoto) is None
    assert two(spark, "iphone_12_pro", "iphone_12_mini", S.common_prefix) == pytest.approx(10 / 13)
    assert two(spark, "", "x", S.common_prefix) == 0.0


def test_bm25(spark):
    score = lambda a, b: two(spark, a.split(), b.split(), Q.bm25_single, "array<string>")
    assert score("red iphone 12", "iphone 12 blue blue") == pytest.approx(-0.549306, abs=1e-6)
    assert score("red iphone 12", "iphone iphone 12") == pytest.approx(-0.667015, abs=1e-6)
    assert score("", "x") is None


def slow_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_edit_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert E.lcs_length(a, b) == slow_lcs(a, b)
        assert E.damerau_levenshtein(a, b) == E.damerau_levenshtein(b, a) <= max(len(a), len(b))
        for f in (E.ratio, E.token_sort, E.token_set, E.weighted, E.jaro_winkler):
            assert 0.0 <= f(a, b) <= 1.0 and f(a, b) == pytest.approx(f(b, a))
    assert E.damerau_levenshtein("ca", "abc") == 2
    assert E.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert E.token_sort("red iphone 12", "iphone 12 blue") == pytest.approx(18 / 27)
    assert E.token_set("a b", "b a c") == 1.0 and E.token_set("", "a") == 0.0
    assert E.lcs_share("iphone_12_pro", "iphone_12_mini") == pytest.approx(10 / 14)
    assert E.weighted("abc", "xx abc yy zz") == pytest.approx(0.9)


def test_edit_udf_nulls(spark):
    df = spark.createDataFrame([("a", None), ("ab", "ab"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(E.token_sort_udf("a", "b")).collect()] == [None, 1.0, None]


def test_attributes(spark):
    js = '{"k":1,"z":[1,2],"o":{"p":2},"e":[],"n":null}'
    assert {e["key"]: e["value"] for e in one(spark, js, A.flat_entries)} == {"k": "1", "z": "1,2", "p": "2", "n": "None"}
    assert one(spark, js, lambda c: A.concat_keyval(A.flat_entries(c))) == "k=1 z=1,2 p=2 n=None"
    assert one(spark, "{cut", A.flat_entries) is None and one(spark, None, A.flat_entries) is None
    maps = lambda a, b: A.fully_equal_share(A.flat_map(a), A.flat_map(b))
    assert two(spark, '{"a":"xy","b":"1"}', '{"a":"yx","b":"2"}', maps) == 0.5
    assert two(spark, '{"a":"1"}', '{"b":"1"}', maps) is None
    kv = one(spark, '{"a":[{"x":null,"y":2},{"z":3}],"b":[1,"q"],"c":{"d":1}}', A.keys_and_values)
    assert kv["keys"] == ["a", "x", "y", "b", "c"] and kv["vals"] == ["none", "2", "1", "q", "{'d': 1}"]


def test_vectors_and_blending(spark):
    assert two(spark, [3.0, 4.0], [4.0, 3.0], V.cosine, "array<float>") == pytest.approx(0.96)
    assert two(spark, [0.0], [1.0], V.cosine, "array<float>") is None
    assert one(spark, [3.0, 4.0], V.normalized, "array<float>") == pytest.approx([0.6, 0.8])
    r = spark.range(1).select(blend(F.lit(0.4), F.lit(0.6), F.lit(0.2)).alias("b"), aligned(F.lit(0.3), F.lit(0.05), F.lit(0.1)).alias("p")).first()
    assert r["b"] == pytest.approx(0.44) and r["p"] == pytest.approx(0.16875)


def test_shared_items_and_trimmed_distance():
    import random

    from pairloom.functions import edit as E

    assert E.shared_items(list("aab"), list("abbb")) == 2.0 and E.shared_items([], ["a"]) == 0.0

    def plain(a, b):
        """The distance without leaving out what both begin and end with."""
        d = {(-1, -1): len(a) + len(b)}
        last = {}
        for i in range(len(a) + 1):
            d[i, -1], d[i, 0] = len(a) + len(b), i
        for j in range(len(b) + 1):
            d[-1, j], d[0, j] = len(a) + len(b), j
        for i in range(1, len(a) + 1):
            met = 0
            for j in range(1, len(b) + 1):
                k, m = last.get(b[j - 1], 0), met
                same = a[i - 1] == b[j - 1]
                if same:
                    met = j
                d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            last[a[i - 1]] = i
        return d[len(a), len(b)]

    rng = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert E.damerau_levenshtein(a, b) == plain(a, b)


def test_partial_against_all_stretches():
    import random

    from pairloom.functions import edit as E

    def plain(a, b):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 1.0 if not b else 0.0
        parts = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
        return max([E.ratio(a, p) for p in parts if p[-1] in a or p[0] in a], default=0.0)

    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd e") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert E.partial(a, b) == plain(a, b)
