"""Queries: items, JSON attributes and attribute information value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pairloom.functions import attrs as A
from pairloom.operators import attribute_idf as I
from pairloom.operators.skew import salted_lookup
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.scratch import Scratch

R = Registry()
JS = "characteristic_attributes_mapping"
ITEM = ["variantid", "name", "description", "category_level_1", "category_level_2", "category_level_3", "category_level_4", JS, "concat_keyval", "n_images", "price"]
CUTS = {1: (10, 25, 50, 75, 100, 150, 200, 250, 500), 2: (10, 25, 50, 75, 100, 150, 200), 3: (10, 25, 50, 75, 100), 4: (10, 25, 50)}
TOP = {1: 75, 2: 50, 3: 50, 4: 25}


def items(spark, d, cols=ITEM):
    """Both sides as one list of distinct items."""
    df = pairs(spark, d)
    sides = [df.select(*[F.col(f"{c}_{k}").alias(c) for c in cols]) for k in (1, 2)]
    return sides[0].unionByName(sides[1]).distinct()


@R.add(
    "SELECT DISTINCT * FROM (SELECT " + ", ".join(f"{c}_1 AS {c}" for c in ITEM) + " FROM train_df UNION ALL SELECT " + ", ".join(f"{c}_2" for c in ITEM) + " FROM train_df)"
)
def items_unpivot(spark, d):
    return items(spark, d)


# flattened members in SQL: objects are walked, of a repeated key the last value counts at the first one's place

def _s_text(j):
    """A JSON value as Python shows it."""
    s = f"({j})::VARCHAR"
    for old, made in (('":', '": '), ('",', '", '), ("},", "}, "), ("],", "], ")):
        s = f"replace({s}, '{old}', '{made}')"
    s = f"""regexp_replace({s}, '([0-9]|null|true|false),("|[{{]|[[]|null|true|false)', '\\1, \\2', 'g')"""
    for old, made in (("null", "None"), ("true", "True"), ("false", "False")):
        s = f"regexp_replace({s}, '([ \\[]){old}([,\\]}}])', '\\1{made}\\2', 'g')"
    s = f"""regexp_replace({s}, '"((?:[^"\\\\]|\\\\.)*)"', '''\\1''', 'g')"""
    return f"CASE json_type({j}) WHEN 'VARCHAR' THEN ({j}) ->> '$' WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN ({j})::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN 'OBJECT' THEN {s} WHEN 'ARRAY' THEN {s} ELSE ({j})::VARCHAR END"


def _s_at(o, k):
    return f"""json_extract({o}, '$."' || {k} || '"')"""


def _s_elements(v):
    return f"json_extract({v}, '$[*]')"


def _s_mixed(v):
    """Whether an array holds anything but objects."""
    return f"len(list_filter({_s_elements(v)}, lambda a: json_type(a) <> 'OBJECT')) > 0"


_MEMBER = _s_at("o", "k")
_S_TEXTS = f"SELECT DISTINCT j FROM (SELECT {JS}_1 AS j FROM train_df UNION ALL SELECT {JS}_2 FROM train_df)"
# w: objects by text and place; m: (t, k, v, pos), one row per flattened key
_S_FLAT = f"""x AS ({_S_TEXTS}),
    w AS (SELECT j AS t, []::BIGINT[] AS path, CASE WHEN json_valid(j) THEN j::JSON END AS o FROM x WHERE json_valid(j) AND json_type(j) = 'OBJECT'
        UNION ALL SELECT t, list_append(path, c.p), c.o FROM (SELECT t, path, unnest(flatten(list_transform(json_keys(o), lambda k, i: CASE json_type({_MEMBER})
            WHEN 'OBJECT' THEN [{{'p': i * 100000, 'o': {_MEMBER}}}]
            WHEN 'ARRAY' THEN CASE WHEN {_s_mixed(_MEMBER)} THEN [] ELSE list_transform({_s_elements(_MEMBER)}, lambda e, z: {{'p': i * 100000 + z, 'o': e}}) END
            ELSE [] END))) AS c FROM w)),
    e AS (SELECT t, list_append(path, i * 100000) AS path, k, {_MEMBER} AS v FROM (SELECT t, path, o, unnest(json_keys(o)) AS k, unnest(range(1, len(json_keys(o)) + 1)) AS i FROM w)),
    f AS (SELECT t, path, k, CASE json_type(v) WHEN 'OBJECT' THEN NULL
            WHEN 'ARRAY' THEN CASE WHEN {_s_mixed('v')} THEN array_to_string(list_transform({_s_elements('v')}, lambda a: {_s_text('a')}), ',') END ELSE {_s_text('v')} END AS v FROM e),
    m AS (SELECT t, k, arg_max(v, path) AS v, min(path) AS pos FROM f WHERE v IS NOT NULL GROUP BY 1, 2)"""
_S_OBJECT = "json_valid({0}) AND json_type({0}) = 'OBJECT'"


@R.add(
    f"""WITH RECURSIVE {_S_FLAT}, l AS (SELECT t, array_to_string(list_sort(list(k || '=' || v)), '|') AS entries FROM m GROUP BY 1)
    SELECT j AS attributes, CASE WHEN {_S_OBJECT.format('j')} THEN coalesce(entries, '') END AS entries FROM x LEFT JOIN l ON l.t = x.j"""
)
def flatten_attrs(spark, d):
    """Entries of every distinct text, nested objects and arrays flattened; null where it is no object."""
    e = _texts(spark, d).select("j", A.flat_entries("j").alias("e"))
    return e.select(F.col("j").alias("attributes"), F.array_join(F.array_sort(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|").alias("entries"))


def _texts(spark, d):
    return pairs(spark, d).select(F.explode(F.array(f"{JS}_1", f"{JS}_2")).alias("j")).distinct()


@R.add(
    f"""WITH RECURSIVE {_S_FLAT}, l AS (SELECT t, array_to_string(list(k || '=' || v ORDER BY pos), ' ') AS kv FROM m GROUP BY 1)
    SELECT variantid_1, variantid_2, {', '.join(f"CASE WHEN {_S_OBJECT.format(f'{JS}_{k}')} THEN coalesce(l{k}.kv, '') END AS keyval_{k}" for k in (1, 2))}
    FROM train_df {' '.join(f'LEFT JOIN l l{k} ON l{k}.t = {JS}_{k}' for k in (1, 2))}"""
)
def concat_keyval(spark, d):
    """``key=value`` texts of both sides' flattened attributes; empty without entries, null where they are no object."""
    return pairs(spark, d).select(*IDS, *[A.concat_keyval(A.flat_entries(f"{JS}_{k}")).alias(f"keyval_{k}") for k in (1, 2)])


def _s_map(k):
    return f"CASE WHEN json_valid({JS}_{k}) AND json_type({JS}_{k}) = 'OBJECT' THEN {JS}_{k}::JSON END"


@R.add(
    f"""WITH j AS (SELECT variantid_1, variantid_2, {_s_map(1)} AS j1, {_s_map(2)} AS j2 FROM train_df)
    SELECT variantid_1, variantid_2, coalesce(len(json_keys(j1)), 0)::INTEGER AS n_keys_1, coalesce(len(json_keys(j2)), 0)::INTEGER AS n_keys_2,
           coalesce(len(list_intersect(json_keys(j1), json_keys(j2))), 0)::INTEGER AS n_common FROM j"""
)
def attr_keys_vals(spark, d):
    """Top-level key lists of both sides and their common part."""
    m = pairs(spark, d).select(*IDS, F.json_object_keys(f"{JS}_1").alias("k1"), F.json_object_keys(f"{JS}_2").alias("k2"), A.keys_and_values(f"{JS}_1").alias("kv1"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return m.select(*IDS, n("k1").alias("n_keys_1"), n("k2").alias("n_keys_2"), n(F.array_intersect("k1", "k2")).alias("n_common"))


def _s_lists(k):
    o, first = f"{JS}_{k}", f"json_extract({_MEMBER}, '$[0]')"
    is_list, nested = f"json_type({_MEMBER}) = 'ARRAY'", f"json_type({first}) = 'OBJECT'"
    keys = f"CASE WHEN {is_list} AND {nested} THEN list_concat([k], json_keys({first})) ELSE [k] END"
    item = _s_text("a")
    none = f"CASE WHEN json_type(a) = 'NULL' THEN 'none' ELSE {item} END"
    vals = f"CASE WHEN {is_list} AND {nested} THEN list_transform(list_transform(json_keys({first}), lambda z: {_s_at(first, 'z')}), lambda a: {none}) WHEN {is_list} THEN list_transform({_s_elements(_MEMBER)}, lambda a: {item}) ELSE [{_s_text(_MEMBER)}] END"
    made = ", ".join(f"coalesce(flatten(list_transform(json_keys(o), lambda k: {c})), [])::VARCHAR[] AS {n}" for n, c in (("keys", keys), ("vals", vals)))
    return f"q{k} AS (SELECT j, {made} FROM (SELECT j, CASE WHEN {_S_OBJECT.format('j')} THEN j::JSON END AS o FROM ({_S_TEXTS})))"


S_LISTS = f"WITH {_s_lists(1)}, q AS (SELECT variantid_1, variantid_2, " + ", ".join(f"{k}.{x} AS attr_{x}_{i}" for i, k in ((1, "a"), (2, "b")) for x in ("keys", "vals")) + f" FROM train_df JOIN q1 a ON a.j IS NOT DISTINCT FROM {JS}_1 JOIN q1 b ON b.j IS NOT DISTINCT FROM {JS}_2)"


@R.add(f"{S_LISTS} SELECT * FROM q")
def attr_lists(spark, d):
    """Key and value lists of both sides: a list's first object gives its keys and values, other lists their items."""
    kv = pairs(spark, d).select(*IDS, *[A.keys_and_values(f"{JS}_{k}").alias(f"kv{k}") for k in (1, 2)])
    return kv.select(*IDS, *[F.col(f"kv{k}.{x}").alias(f"attr_{x}_{k}") for k in (1, 2) for x in ("keys", "vals")])


_LISTS = ("attr_keys_1", "attr_vals_1", "attr_keys_2", "attr_vals_2")


@R.add(f"{S_LISTS} SELECT * FROM q WHERE " + " AND ".join(f"len({c}) > 0" for c in _LISTS))
def nonempty_attr_filter(spark, d):
    """Rows none of whose attribute lists is empty."""
    keep = F.lit(True)
    for c in _LISTS:
        keep = keep & (F.size(c) > 0)
    return attr_lists(spark, d).where(keep)


# key=value lists as the pair table holds them (blank-separated), natively comparable in SQL
_KV = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: contains(w, '=')))"


@R.add(
    f"""WITH RECURSIVE {_S_FLAT}, u AS (SELECT DISTINCT {JS}_1 AS a, {JS}_2 AS b FROM train_df),
    c AS (SELECT a, b, count(*) AS n, count_if(list_sort(list_distinct(string_split(m.v, ''))) = list_sort(list_distinct(string_split(n.v, '')))) AS same
        FROM u JOIN m ON m.t = a JOIN m n ON n.t = b AND n.k = m.k GROUP BY 1, 2)
    SELECT variantid_1, variantid_2, round(same::DOUBLE / n, 6) AS attrs_equal FROM train_df LEFT JOIN c ON a = {JS}_1 AND b = {JS}_2"""
)
def attrs_fully_eq(spark, d):
    """Share of common flattened keys with equal values (as character sets); null without common keys or where a side is no object."""
    m = pairs(spark, d).select(*IDS, *[F.map_from_entries(A.flat_entries(f"{JS}_{k}")).alias(f"m{k}") for k in (1, 2)])
    return m.select(*IDS, r6(A.fully_equal_share(F.col("m1"), F.col("m2"))).alias("attrs_equal"))


CATS = [f"category_level_{k}" for k in (1, 2, 3, 4)]


def keyed(spark, d):
    """Items with category levels and the entries of their ``key=value`` text."""
    return with_entries(items(spark, d, ["variantid", *CATS, "concat_keyval"]), "concat_keyval", "entries")


def with_entries(df, text, out):
    """Distinct ``key=value`` words of a flattened text as entries; of a repeated key the least value counts.

    Each array is a column before the next is made of it, so none is computed
    again for every element.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.rlike("^[^=]+=[^=]+$"))))
    two = F.transform("__words", lambda w: F.struct(F.split_part(w, F.lit("="), F.lit(1)).alias("key"), F.split_part(w, F.lit("="), F.lit(2)).alias("value")))
    first = F.filter("__two", lambda e, i: (i == 0) | (F.get("__two", i - 1)["key"] != e["key"]))
    df = df.withColumn("__words", words).withColumn("__two", two)
    return df.withColumn(out, F.coalesce(first, F.array().cast("array<struct<key:string,value:string>>"))).drop("__words", "__two")


_S_ENTRIES = """SELECT *, split_part(w, '=', 1) AS key, split_part(w, '=', 2) AS value FROM (
    SELECT {cols}, unnest(list_distinct(list_filter(regexp_split_to_array(lower({kv}), '\\s+'), lambda w: regexp_full_match(w, '[^=]+=[^=]+')))) AS w FROM {src})"""
_S_ITEMS = "SELECT DISTINCT " + "{c} FROM (SELECT {one} FROM train_df UNION ALL SELECT {two} FROM train_df)"


def _s_idf(level):
    cols = ["variantid", "category_level_1", "category_level_2", "category_level_3", "category_level_4", "concat_keyval"]
    src = _S_ITEMS.format(c=", ".join(cols), one=", ".join(f"{c}_1 AS {c}" for c in cols), two=", ".join(f"{c}_2" for c in cols))
    cat = f"category_level_{level}"
    return f"""i{level} AS (SELECT {cat} AS cat, row_number() OVER () AS iid, concat_keyval FROM ({src}) WHERE {cat} IS NOT NULL),
    e{level} AS (SELECT cat, iid, key, min(value) AS value FROM ({_S_ENTRIES.format(cols='cat, iid', kv='concat_keyval', src=f'i{level}')}) GROUP BY 1, 2, 3),
    n{level} AS (SELECT cat, count(*) AS n FROM i{level} GROUP BY 1),
    f{level} AS (SELECT cat, key, n, count(*)::DOUBLE / n * ln(count(*)::DOUBLE / count(DISTINCT value)) AS score FROM e{level} JOIN n{level} USING (cat) GROUP BY 1, 2, 3)"""


@R.add(
    "WITH "
    + ", ".join(_s_idf(k) for k in (1, 2, 3, 4))
    + " "
    + " UNION ALL ".join(f"SELECT {k} AS level, cat AS category, key, n AS n_items, round(score, 6) AS score FROM f{k}" for k in (1, 2, 3, 4))
)
def attr_key_tfidf(spark, d):
    """Information value of every attribute key per category, at all four category levels."""
    f = I.attribute_idf_levels(keyed(spark, d), CATS, "entries", Scratch(spark, "idf"))
    return f.select("level", "category", "key", "n_items", r6(F.col("score")).alias("score"))


def with_top(spark, d):
    """By level, pairs with both sides' key-value maps, whether their category agrees, and its ranked keys."""
    scratch = Scratch(spark, "top")
    idf = I.attribute_idf_levels(keyed(spark, d), CATS, "entries", scratch)
    ranked = scratch.save(I.ranked_keys(idf.withColumn("cat", F.struct("level", "category")), "cat", max(c[-1] for c in CUTS.values())))
    df = pairs(spark, d).select(*IDS, *[f"{c}_{k}" for c in CATS for k in (1, 2)], *[f"concat_keyval_{k}" for k in (1, 2)])
    for k in (1, 2):
        df = with_entries(df, f"concat_keyval_{k}", f"e{k}")
    df = scratch.save(df.select(*IDS, *[f"{c}_{k}" for c in CATS for k in (1, 2)], *[F.map_from_entries(f"e{k}").alias(f"m{k}") for k in (1, 2)]))
    for level, c in enumerate(CATS, 1):
        top = ranked.where(F.col("cat.level") == level).select(F.col("cat.category").alias("cat"), "top")
        one = df.select(*IDS, F.col(f"{c}_1").alias("cat"), (F.col(f"{c}_1") == F.col(f"{c}_2")).alias("same"), "m1", "m2")
        # few categories hold most pairs
        yield level, salted_lookup(one, top, ["cat"], F.concat(*IDS), "left")


def _s_pairs(level):
    cat = f"category_level_{level}"
    side = lambda k: f"SELECT pid, key, min(value) AS value FROM ({_S_ENTRIES.format(cols='pid', kv=f'concat_keyval_{k}', src='p')}) GROUP BY 1, 2"
    return f"""p AS (SELECT row_number() OVER () AS pid, variantid_1, variantid_2, {cat}_1 AS cat, coalesce({cat}_1 = {cat}_2, false) AS same, concat_keyval_1, concat_keyval_2 FROM train_df),
    a AS ({side(1)}), b AS ({side(2)}), r AS (SELECT cat, key, score, row_number() OVER (PARTITION BY cat ORDER BY score DESC, key DESC) AS rk FROM f{level}),
    t AS (SELECT p.pid, rk, score, a.value = b.value AND same AS hit FROM p JOIN r USING (cat) LEFT JOIN a ON a.pid = p.pid AND a.key = r.key LEFT JOIN b ON b.pid = p.pid AND b.key = r.key)"""


def _s_levels(one):
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_s_idf(k)}, {_s_pairs(k)} {one(k)})" for k in (1, 2, 3, 4))


def _s_hits(k):
    return f"""SELECT {k} AS level, variantid_1, variantid_2, coalesce(sum(CASE WHEN hit AND rk <= {TOP[k]} THEN 1 ELSE 0 END), 0)::BIGINT AS n_match,
        coalesce(string_agg(CASE WHEN hit AND rk <= {TOP[k]} THEN rk::VARCHAR END, ',' ORDER BY rk), '') AS ranks FROM p LEFT JOIN t ON t.pid = p.pid GROUP BY p.pid, variantid_1, variantid_2"""


@R.add(_s_levels(_s_hits))
def top_attr_match(spark, d):
    """Which of the category's most informative keys both sides give with the same value, at all four levels."""

    def one(level, df):
        flags = df.select(*IDS, I.match_flags(F.col("m1"), F.col("m2"), F.col("same"), F.col("top"), TOP[level]).alias("f"))
        hit = F.filter(F.transform("f", lambda x, i: F.when(x == 1, i + 1)), lambda i: i.isNotNull())
        return flags.select(F.lit(level).alias("level"), *IDS, hit.alias("hit")).select("level", *IDS, F.size("hit").cast("long").alias("n_match"), F.array_join("hit", ",").alias("ranks"))

    return reduce(lambda x, y: x.unionByName(y), [one(level, df) for level, df in with_top(spark, d)])


def _s_share(cut):
    return f"CASE WHEN same AND coalesce(sum(CASE WHEN rk <= {cut} THEN score END), 0) > 1e-12 THEN round(coalesce(sum(CASE WHEN rk <= {cut} AND hit THEN score END), 0) / sum(CASE WHEN rk <= {cut} THEN score END), 6) ELSE 0 END"


def _s_shares(k):
    return f"SELECT {k} AS level, variantid_1, variantid_2, [{', '.join(map(_s_share, CUTS[k]))}]::DOUBLE[] AS shares FROM p LEFT JOIN t ON t.pid = p.pid GROUP BY p.pid, variantid_1, variantid_2, same"


@R.add(_s_levels(_s_shares))
def weighted_attr_match(spark, d):
    """Weight of agreeing keys among the category's first keys, at all cuts of all four levels."""
    one = lambda level, df: df.select(F.lit(level).alias("level"), *IDS, F.array(*[r6(I.weighted_share(F.col("m1"), F.col("m2"), F.col("same"), F.col("top"), c)) for c in CUTS[level]]).alias("shares"))
    return reduce(lambda x, y: x.unionByName(y), [one(level, df) for level, df in with_top(spark, d)])
