"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import nested
from pairloom.operators.tree_agg import approx_distinct, count_rows, count_values, frequent_keys, max_of, mean_of, min_of, tree_aggregate
from pairloom.scratch import Scratch
from pairloom.sources.tables import table


def p2_found(spark, d):
    return frequent_keys(table(spark, d, "train_df"), "unique_cat_1").select("unique_cat_1")


def p2_stats(spark, d):
    df = table(spark, d, "train_df").select("unique_cat_1", "price_1", "n_images_1")
    states = count_rows() + count_values("price_1", "n_priced") + min_of("price_1", "price_min") + max_of("price_1", "price_max") + mean_of("n_images_1", "mean_images")
    return tree_aggregate(df, ["unique_cat_1"], states).withColumn("mean_images", F.round("mean_images", 6))


def p2_listings(spark, d):
    """Distinct listings per category by mergeable sketches."""
    return tree_aggregate(table(spark, d, "train_df").select("unique_cat_1", "variantid_1"), ["unique_cat_1"], count_rows() + approx_distinct("variantid_1", "n_listings"))


def _flat_table(spark, d, tag):
    """One of the flat tables: the tagged stream is written by tag in one pass and read with the tag's schema."""
    tagged = nested.flatten_records(table(spark, d, "train_df"), "variantid_1", "characteristic_attributes_mapping_1", (tag,))
    path = f"{Scratch(spark, 'nested').root}/tables"
    nested.write_tables(tagged, path)
    return nested.read_table(spark, path, tag, "variantid_1")


def p7_found(spark, d):
    return _flat_table(spark, d, "object").select("variantid_1", "parent_path", "node_path").distinct()


def p7_values(spark, d):
    """Scalars with their paths, texts and numbers."""
    return _flat_table(spark, d, "value")


def p7_listings(spark, d):
    """Listings whose attributes can be parsed."""
    return _flat_table(spark, d, "listing")


QUERIES = {f.__name__: f for f in (p2_found, p2_stats, p2_listings, p7_found, p7_values, p7_listings)}

# members below the top, walked breadth-first; a top-level string that is itself JSON is unquoted first
_WALK = """
        WITH RECURSIVE one AS (
            SELECT variantid_1, min(characteristic_attributes_mapping_1) AS js FROM train_df WHERE variantid_1 IS NOT NULL GROUP BY 1
        ), good AS (
            SELECT variantid_1, js::JSON AS j FROM one WHERE json_valid(js) AND json_type(js) IN ('OBJECT', 'ARRAY')
        ), walk AS (
            SELECT variantid_1, '$' AS node_path, '$' AS parent_path, NULL::VARCHAR AS name, j, 0 AS depth FROM good
            UNION ALL
            SELECT variantid_1, m.p, CASE WHEN t = 'OBJECT' THEN up ELSE parent END, m.k,
                   CASE WHEN depth = 0 AND t = 'OBJECT' AND json_type(m.v) = 'VARCHAR' AND json_valid(m.v ->> '$') AND json_type(m.v ->> '$') IN ('OBJECT', 'ARRAY')
                        THEN (m.v ->> '$')::JSON ELSE m.v END, depth + 1
            FROM (
                SELECT variantid_1, depth, json_type(j) AS t, node_path AS up, parent_path AS parent, unnest(
                    CASE json_type(j)
                        WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: {'p': node_path || '.' || k, 'k': k, 'v': json_extract(j, '$."' || k || '"')})
                        WHEN 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: {'p': node_path || '[' || i || ']', 'k': NULL, 'v': json_extract(j, '$[' || i || ']')})
                    END) AS m
                FROM walk WHERE json_type(j) IN ('OBJECT', 'ARRAY')
            )
        )"""

SQL = {
    "p2_found": "SELECT unique_cat_1 FROM train_df WHERE unique_cat_1 IS NOT NULL GROUP BY 1 HAVING count(*) * 100 >= (SELECT count(*) FROM train_df) * 5",
    "p2_stats": """
        SELECT unique_cat_1, count(*) AS n_rows, count(price_1) AS n_priced, min(price_1) AS price_min, max(price_1) AS price_max,
               round(avg(n_images_1), 6) AS mean_images
        FROM train_df GROUP BY 1""",
    "p7_listings": "SELECT variantid_1 FROM (SELECT variantid_1, min(characteristic_attributes_mapping_1) AS js FROM train_df WHERE variantid_1 IS NOT NULL GROUP BY 1) WHERE json_valid(js) AND json_type(js) IN ('OBJECT', 'ARRAY')",
    "p7_found": f"{_WALK} SELECT DISTINCT variantid_1, parent_path, node_path FROM walk WHERE json_type(j) = 'OBJECT' AND node_path <> '$'",
    "p7_values": f"""{_WALK} SELECT variantid_1, parent_path, node_path, name, CASE json_type(j) WHEN 'VARCHAR' THEN j ->> '$' ELSE j::VARCHAR END AS value,
        CASE WHEN json_type(j) NOT IN ('VARCHAR', 'NULL', 'BOOLEAN') THEN j::DOUBLE END AS number FROM walk WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY')""",
}
