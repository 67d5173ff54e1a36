import json

import pytest

from pairloom.operators import nested as N


def brute(text):
    """Objects below the top by plain recursion."""
    try:
        top = json.loads(text)
    except (TypeError, ValueError):
        return []
    out = []

    def walk(node, path, parent, top_member):
        if isinstance(node, str) and top_member:
            try:
                inner = json.loads(node)
            except ValueError:
                inner = None
            if isinstance(inner, (dict, list)):
                node = inner
        if isinstance(node, dict):
            if path != "$":
                out.append((parent, path))
            for k, v in node.items():
                walk(v, f"{path}.{k}", path, path == "$")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]", parent, False)

    if isinstance(top, (dict, list)):
        walk(top, "$", "$", False)
    return sorted(out)


CASES = [
    '{"a":{"b":{}},"c":[{"d":1},[{"e":{}}],2],"s":"{\\"x\\":{\\"y\\":[{}]}}","t":"[{\\"q\\":1}]","n":null}',
    '{"a":{"s":"{\\"deep\\":1}"}}',  # text in a string below the top stays text
    "[{},{\"a\":{}}]",
    "{}",
    "",
    None,
    '{"cut": {"a": 1',
    '"text"',
    "3",
    '{"a":1,"a":{"b":2}}',  # the last member of a name counts
    '{"s":"{broken","u":"[1,2]","v":"  {\\"k\\":{}}"}',
    '{"a":' * 40 + "1" + "}" * 40,
]


@pytest.mark.parametrize("text", CASES)
def test_visit_matches_recursion(text):
    assert sorted((p, n) for tag, n, p, *_ in N.visit(text) if tag == "object") == brute(text)


def test_nesting_beyond_the_parser_is_unparsable():
    assert list(N.visit("[" * 200_000)) == []


def test_tables(spark, tmp_path):
    data = [(str(i), c, "x") for i, c in enumerate(CASES)] + [("0", CASES[0], "x"), (None, CASES[0], "x"), ("s", '{"\\ud83d":{"k":1}}', "x")]
    df = spark.createDataFrame(data, "id string, js string, tag string")
    tagged = N.flatten_records(df, "id", "js")
    got = {}
    for r in N.objects(tagged, "id").collect():
        got.setdefault(r["id"], []).append((r["parent_path"], r["node_path"]))
    for i, c in enumerate(CASES):
        assert sorted(got.get(str(i), [])) == brute(c)
    assert got["s"] == [("$", "$.�")]
    # one pass writes all tables; each is read back by its tag alone
    N.write_tables(tagged, str(tmp_path / "t"))
    back = N.read_table(spark, str(tmp_path / "t"), "object", "id")
    assert sorted(map(tuple, back.select("id", "node_path").collect())) == sorted((i, n) for i, rows in got.items() for _, n in rows)
    vals = {(r["id"], r["node_path"]): (r["value"], r["number"]) for r in N.read_table(spark, str(tmp_path / "t"), "value", "id").collect()}
    assert vals["0", "$.c[0].d"] == ("1", 1.0) and vals["0", "$.n"] == ("null", None)
    assert vals["9", "$.a.b"] == ("2", 2.0) and vals["1", "$.a.s"] == ('{"deep":1}', None)
    # every value's and object's parent is a known object or the top
    known = {(i, n) for i, rows in got.items() for _, n in rows}
    for r in N.values(tagged, "id").collect():
        assert r["parent_path"] == "$" or (r["id"], r["parent_path"]) in known


def test_empty_and_long(spark):
    assert N.flatten_records(spark.createDataFrame([], "id string, js string"), "id", "js").collect() == []
    wide = json.dumps({"a": [{"i": i} for i in range(30_000)], "t": "x" * 500_000})
    df = spark.createDataFrame([("1", wide)], "id string, js string")
    assert N.flatten_records(df, "id", "js", ("object",)).count() == 30_000
