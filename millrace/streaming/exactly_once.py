"""Exactly-once consumption of a stream into a folder of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def consume(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch overwrites its own partition batch=<id>, so a replayed batch changes nothing.

    The offsets are committed by the checkpoint only after the batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
