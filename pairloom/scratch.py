"""Tables that cut lineage, in a folder that every executor can read.

The folder is the one the session names in ``spark.checkpoint.dir``; only on a
local master, where one machine is all there is, may it be left unset.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master set once to a temporary one where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pairloom-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Parquet stages of one query.

    ``save`` writes a frame and returns it read back: a lost executor costs a
    re-read, not a recomputation, and row counts come from file footers.
    ``drop`` deletes a superseded stage; what is left is deleted at exit, since
    the frame that a query returns may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.mode("overwrite").option("compression", "lz4").partitionBy(*partition_by or []).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._pairloom_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_pairloom_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            local = self.root.removeprefix("file://")
            if os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
