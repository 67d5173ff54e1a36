"""Nested JSON records to flat, linked tables in one pass.

A depth-first visitor walks each record once and emits rows tagged with the
table they belong to; every row carries its own key (the path in its record)
and its parent's. The tagged stream is written partitioned by tag, and each
table's schema is applied when it is read back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ("listing", "object", "value")
SCHEMA = "tag string, {id} string, node_path string, parent_path string, name string, payload string"


def _clean(s: str) -> str:
    """A lone surrogate has no UTF-8 form; it becomes U+FFFD."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _parsed(text):
    try:
        return json.loads(text)
    except (ValueError, RecursionError, TypeError):
        return None


def visit(text: str | None, tags: frozenset[str] = frozenset(TAGS)) -> Iterator[tuple]:
    """Rows ``(tag, node_path, parent_path, name, payload)`` of one record.

    Text that is null or no JSON object or array gives no rows. The parent of a
    node is the nearest object around it; array elements have no name. A member
    of the top-level object whose string value is itself a JSON object or array
    is walked as if it stood there unquoted; deeper strings are plain values.
    Of repeated member names the last counts. Scalars become JSON text.
    """
    top = _parsed(text) if text else None
    if not isinstance(top, (dict, list)):
        return
    if "listing" in tags:
        yield "listing", "$", None, None, None
    # (node, path, parent object's path, name, depth in members below the top)
    stack = [(top, "$", "$", None, 0)]
    while stack:
        node, path, parent, name, depth = stack.pop()
        if isinstance(node, str) and depth == 1 and isinstance(top, dict):
            t = node.lstrip()
            inner = _parsed(node) if t[:1] in ("{", "[") else None
            if isinstance(inner, (dict, list)):
                node = inner
        if isinstance(node, dict):
            if path != "$" and "object" in tags:
                yield "object", path, parent, name, None
            stack.extend((v, f"{path}.{k}", path, k, depth + 1) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((v, f"{path}[{i}]", parent, None, depth + 1) for i, v in reversed(list(enumerate(node))))
        elif "value" in tags:
            yield "value", path, parent, name, json.dumps(node, ensure_ascii=False)


def flatten_records(df: DataFrame, id_col: str, json_col: str, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """The tagged stream of all records, one record per distinct id.

    Where copies of an id differ, the least text counts (nulls last). Only the
    two named columns are read; ``tags`` limits what the visitor emits. Null
    ids are dropped. No shuffle follows the one that finds the distinct ids.
    """
    wanted = frozenset(tags)
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(json_col).alias("js"))
    schema = pa.schema([(n, pa.string()) for n in ("tag", "id", "node_path", "parent_path", "name", "payload")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, js in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for tag, path, parent, name, payload in visit(js, wanted):
                    row = (tag, i, path, parent, name, payload)
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(cols[0]) >= 50_000:
                    yield _batch(cols, schema)
                    cols = [[] for _ in range(6)]
            if cols[0]:
                yield _batch(cols, schema)

    return one.where(F.col("js").isNotNull()).mapInArrow(walk, SCHEMA.format(id="id")).withColumnRenamed("id", id_col)


def _batch(cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    try:
        arrays = [pa.array(c, pa.string()) for c in cols]
    except UnicodeEncodeError:
        arrays = [pa.array([None if v is None else _clean(v) for v in c], pa.string()) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def objects(tagged: DataFrame, id_col: str) -> DataFrame:
    return tagged.where("tag = 'object'").select(id_col, "parent_path", "node_path", "name")


def values(tagged: DataFrame, id_col: str) -> DataFrame:
    """Scalars with a typed view of the payload: number where it is one."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), "payload", F.lit("}")), "$.v")
    return tagged.where("tag = 'value'").select(
        id_col,
        "parent_path",
        "node_path",
        "name",
        F.when(F.startswith("payload", F.lit('"')), text).otherwise(F.col("payload")).alias("value"),
        F.expr("CASE WHEN payload RLIKE '^-?[0-9]' THEN try_cast(payload AS double) END").alias("number"),
    )


def listings(tagged: DataFrame, id_col: str) -> DataFrame:
    return tagged.where("tag = 'listing'").select(id_col)


def write_tables(tagged: DataFrame, path: str) -> None:
    """One pass over the input, one folder per tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, id_col: str) -> DataFrame:
    """A table of ``write_tables`` with its schema; other tags are not read."""
    shape = {"listing": listings, "object": objects, "value": values}[tag]
    return shape(spark.read.schema(SCHEMA.format(id=id_col)).parquet(path), id_col)
