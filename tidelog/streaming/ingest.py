"""Streams of operations into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None):
    """Write a stream of (key, kind, value, embedding, ordinal) to the store, a run for each micro-batch.

    A batch that is delivered again after a failure is recognised by its number,
    which is committed with the batch's run under the checkpoint's path, so each is
    applied once.  Order is by sequence, so no watermark is needed: within a batch
    by ordinal.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.put_many(batch, checkpoint, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_live(stream: DataFrame) -> DataFrame:
    """The newest entry of each key of a stream of (seq, key, kind, value), for complete or update output."""
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("kind", "value"), "seq").alias("won"))
