"""Incremental appends, beyond batch building: new documents become postings, new operations join a version log.

Both are append-only writes per micro-batch, named by the batch number, so a batch that runs again after a failure replaces
what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import postings as P


def _sink(path: str, change: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_postings(
    docs: DataFrame, path: str, checkpoint: str, profile: P.Profile = P.Profile(), config: P.IndexConfig = P.IndexConfig()
) -> StreamingQuery:
    """Postings of a stream of documents (doc_id, text), a folder per micro-batch below path."""
    sink = _sink(path, lambda batch: P.postings(batch, profile, config))
    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(operations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of operations (key, seq, op, value) appended to a version log below path."""
    sink = _sink(path, lambda batch: batch.select("key", "seq", F.col("op").cast("tinyint").alias("op"), "value"))
    return operations.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
