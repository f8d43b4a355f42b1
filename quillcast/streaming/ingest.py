"""Batch operators on a stream: each micro-batch goes through a cleaning plan and into a folder of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, clean: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append clean(batch) to `path` under batch=<id>; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
