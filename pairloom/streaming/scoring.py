"""Scoring new pairs as they arrive: the batch expressions on a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(pairs: DataFrame, features: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes ``features`` of each micro-batch to ``path``, one folder per batch.

    ``features`` may be any row-wise frame function, also one that Structured
    Streaming would not take (joins with scores, UDFs). A batch that is run again
    after a failure overwrites its own folder, so every pair is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        features(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
