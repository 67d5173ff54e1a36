"""JSON attributes as maps and lists.

Deep flattening and Python-style rendering of nested values need a visitor, so
they run as Arrow UDFs; everything on the flat map is native.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# type objects, not strings: parsing a string needs a running session
ENTRIES = ArrayType(StructType().add("key", StringType()).add("value", StringType()))
KEYS_VALS = StructType().add("keys", ArrayType(StringType())).add("vals", ArrayType(StringType()))


def _load(text):
    if not text:
        return None
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def flatten(d: dict) -> dict[str, str]:
    """Nested objects' members hoisted without their parent's name; a later one wins.

    A list of objects gives each one's members, another list its items joined
    by commas, an empty list nothing; scalars are rendered as Python shows them.
    """
    out: dict[str, str] = {}
    todo = [iter(d.items())]
    while todo:
        for k, v in todo[-1]:
            if isinstance(v, dict):
                todo.append(iter(v.items()))
                break
            if isinstance(v, list):
                if v and all(isinstance(x, dict) for x in v):
                    todo.append(iter([kv for x in v for kv in x.items()]))
                    break
                if v:
                    out[k] = ",".join(map(str, v))
            else:
                out[k] = str(v)
        else:
            todo.pop()
    return out


def _clean(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.pandas_udf(ENTRIES)
def flat_entries(texts: pd.Series) -> pd.Series:
    """Flattened members in their order; null for null, unparsable or non-object text."""
    memo: dict = {}
    out = []
    for t in texts:
        if t not in memo:
            d = _load(t)
            memo[t] = None if d is None else [{"key": _clean(k), "value": _clean(v)} for k, v in flatten(d).items()]
        out.append(memo[t])
    return pd.Series(out)


@F.pandas_udf(KEYS_VALS)
def keys_and_values(texts: pd.Series) -> pd.DataFrame:
    """Key and value lists: a list's first object gives its keys and values, other lists their items."""
    keys, vals = [], []
    for t in texts:
        d = _load(t)
        ks, vs = [], []
        for k, v in (d or {}).items():
            ks.append(k)
            if isinstance(v, list):
                if v and isinstance(v[0], dict):
                    ks += list(v[0])
                    vs += ["none" if x is None else str(x) for x in v[0].values()]
                else:
                    vs += [str(x) for x in v]
            else:
                vs.append(str(v))
        keys.append(list(map(_clean, ks)))
        vals.append(list(map(_clean, vs)))
    return pd.DataFrame({"keys": keys, "vals": vals})


def concat_keyval(entries: Column) -> Column:
    """``key=value`` joined by blanks, in order; null for null."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def flat_map(text: Column) -> Column:
    """A flat object's members as strings, natively; null where it cannot be parsed."""
    return F.from_json(text, "map<string,string>")


def fully_equal_share(a: Column, b: Column) -> Column:
    """Share of common keys whose values have the same characters as a set; null without common keys."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    as_set = lambda v: F.array_sort(F.array_distinct(F.split(v, "")))
    same = F.filter(both, lambda k: as_set(F.element_at(a, k)) == as_set(F.element_at(b, k)))
    return F.try_divide(F.size(same).cast("double"), F.size(both))
