"""Scans, sinks and schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw column names of the pair files and the names used inside.
RENAMES = {
    f"{raw}_{old}": f"{new}_{k}"
    for k, raw in ((1, "base"), (2, "cand"))
    for old, new in {
        "item_id": "variantid", "title": "name", "description": "description", "category_name": "category_level_1", "subcategory_name": "category_level_2",
        "param1": "category_level_3", "param2": "category_level_4", "json_params": "characteristic_attributes_mapping", "count_images": "n_images", "price": "price",
    }.items()
}
UNLABELLED = {"is_double": "int", "action_date": "string", "group_id": "bigint"}


def read_parts(spark: SparkSession, paths: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Parquet parts as one frame: renamed, missing label columns as -1, columns matched by name.

    A column that only some parts have is null in the others; types widen to the
    first part's that has the column.
    """
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        df = df.withColumnsRenamed({k: v for k, v in (renames or {}).items() if k in df.columns})
        df = df.withColumns({c: F.lit("-1").cast(t) for c, t in UNLABELLED.items() if c not in df.columns})
        if out is not None:
            types = dict(out.dtypes)
            df = df.withColumns({c: df[c].cast(types[c]) for c, t in df.dtypes if c in types and types[c] != t})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_projected(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All parquet files under a path; only the named columns reach the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-empty lines as ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_images(spark: SparkSession, path: str, glob: str = "*.jpg", after: str | None = None) -> DataFrame:
    """``(filename, content)`` of non-empty files; the listing is filtered before contents are read.

    ``after`` resumes a scan: only files whose name comes behind it are read.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    df = df.where("length > 0").select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("filename"), "content")
    return df if after is None else df.where(F.col("filename") > after)


def write_files(df: DataFrame, path: str, name: str, content: str) -> None:
    """Each row's bytes as one file, written one after the other from the driver: for word lists and fixtures alone."""
    fs = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for r in df.select(name, content).toLocalIterator():
        p = fs.Path(f"{path}/{r[0]}")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(r[1]))
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One text column, one line per row."""
    df.write.mode("overwrite").text(path)


def compact(df: DataFrame, path: str, files: int) -> None:
    """Many small files as ``files`` larger ones."""
    df.coalesce(files).write.mode("overwrite").parquet(path)


def score_partitions(df: DataFrame, scorer, schema: str) -> DataFrame:
    """A model's scores per batch of rows, in Arrow batches: the slot for any encoder or classifier.

    ``scorer`` maps an iterator of pandas frames to one; keys must be among its
    columns, since scores are attached by key and never by position.
    """
    return df.mapInPandas(scorer, schema)
