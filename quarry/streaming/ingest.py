"""Incremental ingest: micro-batches of a stream through the set-wise pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.store import RecordStore


def ingest_stream(store: RecordStore, cls: type, rows: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Save a stream of flat records of ``cls``; each micro-batch is one commit.

    Classes that are found by content or value take a replayed batch without
    effect, so delivery is exactly once for them.  ``trigger`` goes to the writer,
    ``availableNow=True`` by default.
    """

    def save(batch: DataFrame, _: int) -> None:
        store.ingest_frame(cls, batch)

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
