"""Queries: whole-frame operations (columns, order, samples, chains), sinks read again, and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators.ranking import global_rank
from pairloom.plans.base import IDS, Registry, pairs, r6
from pairloom.plans.texts import _s_len, s_norm
from pairloom.scratch import Scratch
from pairloom.sources import io
from pairloom.sources.tables import table
from pairloom.streaming.scoring import score_stream

R = Registry()
C = F.col
SAMPLE = 10_000
BATCH = 128


def drop_columns(df: DataFrame, names: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the named columns and without those whose names hold one of ``parts``; others' names do no harm."""
    return df.drop(*[c for c in df.columns if c in names or any(p in c for p in parts)])


@R.add("SELECT COLUMNS(c -> NOT (contains(c, 'category') OR contains(c, 'mapping') OR c IN ('description_1', 'description_2', 'loaded_at', 'action_date'))) FROM train_df".replace("c ->", "lambda c:"))
def drop_by_name(spark, d):
    """The pair table without columns by list and by part of their name."""
    return drop_columns(pairs(spark, d), ("description_1", "description_2", "loaded_at", "action_date"), ("category", "mapping"))


@R.add("SELECT *, row_number() OVER (ORDER BY variantid_1, variantid_2) AS place FROM (SELECT DISTINCT variantid_1, variantid_2 FROM train_df)")
def sort_pairs(spark, d):
    """Distinct pairs with their place in the order of both ids."""
    return global_rank(pairs(spark, d).select(*IDS).distinct(), Scratch(spark, "sort"), [F.asc(c) for c in IDS], "place")


def seeded(seed: int, *cols: str):
    """An order that depends on the seed and the columns alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


_S_SEEDED = "row_number() OVER (ORDER BY md5(concat_ws('|', '42', variantid_1, variantid_2)), variantid_1, variantid_2, is_double)"


@R.add(f"SELECT variantid_1, variantid_2, is_double, {_S_SEEDED} AS place FROM (SELECT DISTINCT variantid_1, variantid_2, is_double FROM train_df)")
def seeded_shuffle(spark, d):
    """Every pair with a place in an order that depends on the seed and the ids alone."""
    df = pairs(spark, d).select(*IDS, "is_double").distinct()
    return global_rank(df, Scratch(spark, "shuffle"), [seeded(42, *IDS).asc(), *[F.asc(c) for c in (*IDS, "is_double")]], "place")


@R.add(f"SELECT variantid_1, variantid_2, is_double FROM (SELECT DISTINCT variantid_1, variantid_2, is_double FROM train_df) QUALIFY {_S_SEEDED} <= {SAMPLE}")
def sample_pairs(spark, d):
    """A seeded sample of ten thousand pairs: the number is the feature."""
    return seeded_shuffle(spark, d).where(C("place") <= SAMPLE).drop("place")


_NAMES = {1: "double", 0: "other", -1: "unlabelled"}


@R.add("SELECT variantid_1, variantid_2, CASE is_double WHEN 1 THEN 'double' WHEN 0 THEN 'other' WHEN -1 THEN 'unlabelled' END AS label FROM train_df")
def map_values(spark, d):
    """Values substituted by a table; a value that it lacks becomes null."""
    names = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    return pairs(spark, d).select(*IDS, F.try_element_at(names, "is_double").alias("label"))


@R.add("SELECT CASE WHEN is_double <> 1 THEN 'test' ELSE 'train' END AS part, is_double = 0 AS leaked, count(*) AS n FROM train_df GROUP BY 1, 2")
def split_leaky(spark, d):
    """The split that takes all but confirmed duplicates as test rows, with the labelled negatives that so leak into it."""
    part = F.when(C("is_double") != 1, "test").otherwise("train")
    return pairs(spark, d).groupBy(part.alias("part"), (C("is_double") == 0).alias("leaked")).agg(F.count(F.lit(1)).alias("n"))


_NUMBERS = {
    "price_1": "price_1", "price_2": "price_2", "n_images_1": "n_images_1", "n_images_2": "n_images_2", "is_same_location": "is_same_location", "is_same_region": "is_same_region",
    "name_length_1": "length(name_1)", "name_length_2": "length(name_2)", "description_length_1": "length(description_1)", "description_length_2": "length(description_2)",
    "same_category": "CAST(lower(category_level_1_1) = lower(category_level_1_2) AS INTEGER)", "images_gap": "abs(n_images_1 - n_images_2)", "names_gap": "abs(length(name_1) - length(name_2))",
}


@R.add(
    " UNION ALL ".join(f"SELECT '{k}' AS feature, round(abs(corr(({v})::DOUBLE, is_double::DOUBLE)), 6) AS strength FROM train_df WHERE is_double IN (0, 1)" for k, v in _NUMBERS.items())
    + " ORDER BY strength DESC, feature LIMIT 50"
)
def feature_strength(spark, d):
    """The fifty features of strongest correlation with the label: the number is the feature."""
    df = pairs(spark, d).where("is_double IN (0, 1)")
    one = df.agg(*[F.struct(F.lit(k).alias("feature"), r6(F.abs(F.corr(F.expr(v).cast("double"), C("is_double").cast("double")))).alias("strength")).alias(k) for k, v in _NUMBERS.items()])
    return one.select(F.explode(F.array(*_NUMBERS)).alias("e")).select("e.*").orderBy(F.desc("strength"), "feature").limit(50)


def chain(df: DataFrame, steps) -> DataFrame:
    """Frame functions applied in order."""
    for step in steps:
        df = df.transform(step)
    return df


@R.add(f"WITH n AS (SELECT variantid_1, variantid_2, {s_norm('name_1')} AS name FROM train_df WHERE name_1 IS NOT NULL) SELECT variantid_1, variantid_2, name, length(name)::INTEGER AS size FROM n WHERE length(name) > 8")
def transform_chain(spark, d):
    """Preparation as a list of frame functions."""
    steps = [
        lambda x: x.where("name_1 IS NOT NULL").select(*IDS, "name_1"),
        lambda x: x.select(*IDS, T.normalize_underscore("name_1").alias("name")),
        lambda x: x.withColumn("size", F.length("name")).where("size > 8"),
    ]
    return chain(pairs(spark, d), steps)


@R.add("SELECT variantid_1, variantid_2, is_double, score FROM oof_scores")
def csv_roundtrip(spark, d):
    """A table written as CSV with a header and read with its schema."""
    path = f"{Scratch(spark, 'csv').root}/out"
    io.write_csv(table(spark, d, "oof_scores").select(*IDS, "is_double", "score"), path)
    return io.read_csv(spark, path, "variantid_1 string, variantid_2 string, is_double int, score double")


@R.add("SELECT trim(brand, ' ') AS value FROM brands WHERE trim(brand, ' ') <> ''")
def lines_roundtrip(spark, d):
    """A word list written as text lines and read trimmed, empty lines left out."""
    path = f"{Scratch(spark, 'lines').root}/out"
    io.write_lines(table(spark, d, "brands").where("brand IS NOT NULL").select("brand"), path)
    return io.read_lines(spark, path)


@R.add(f"SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH} AS batch FROM embeddings")
def embedding_batches(spark, d):
    """Embeddings written in numbered batches of stated size and read again by batch."""
    scratch = Scratch(spark, "batches")
    ranked = global_rank(table(spark, d, "embeddings"), scratch, [F.asc("vec_id")], "place")
    staged = scratch.save(ranked.withColumn("batch", F.floor((C("place") - 1) / BATCH).cast("long")).drop("place"), partition_by=["batch"])
    return staged.select("vec_id", "label", "batch")


@R.add(
    "WITH w AS (SELECT DISTINCT lower(trim(word_0, ' ')) AS w FROM colors WHERE trim(word_0, ' ') <> ''), f AS (SELECT md5(w) AS filename, w, row_number() OVER (ORDER BY w) AS k FROM w)"
    " SELECT filename, octet_length(encode(w))::INTEGER AS size FROM f WHERE k % 3 <> 0 AND filename > '4'"
)
def image_scan(spark, d):
    """Binary files (one for each colour, every third empty, with others beside them) scanned by name from a place on."""
    path = f"{Scratch(spark, 'images').root}/files"
    words = table(spark, d, "colors").select(F.lower(F.trim("word_0")).alias("w")).where("w <> ''").distinct()
    # a fixed list of a few dozen words
    ranked = global_rank(words, Scratch(spark, "words"), [F.asc("w")], "k").withColumn("content", F.encode(F.when(C("k") % 3 != 0, C("w")).otherwise(""), "UTF-8"))
    for ending in ("jpg", "txt"):
        io.write_files(ranked.withColumn("name", F.concat(F.md5("w"), F.lit(f".{ending}"))), path, "name", "content")
    return io.read_images(spark, path, "*.jpg", after="4").select("filename", F.length("content").alias("size"))


@R.add(f"SELECT variantid_1, variantid_2, {_s_len('name_1')}::INTEGER AS size, abs(n_images_1 - n_images_2)::BIGINT AS images_gap FROM train_df")
def scored_stream(spark, d):
    """The pair table read as a stream and scored batch by batch, each pair once."""
    root = Scratch(spark, "stream").root
    source = pairs(spark, d).select(*IDS, "name_1", "n_images_1", "n_images_2")
    source.write.mode("overwrite").parquet(f"{root}/in")
    score = lambda b: b.select(*IDS, T.token_length(T.lowered(T.clean_html_emoji("name_1"))).alias("size"), F.abs(C("n_images_1") - C("n_images_2")).cast("long").alias("images_gap"))
    score_stream(spark.readStream.schema(source.schema).parquet(f"{root}/in"), score, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")
