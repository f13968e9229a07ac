"""Mutations from a stream (an extension).

Order among mutations is by their own ``order`` column within a micro-batch and by arrival
between micro-batches, so late rows need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keystrata.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Write ``key, op, value`` rows of a stream to a store.

    A micro-batch that is repeated after a failure is skipped if its number was published, which
    happens in the same manifest version as its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.state.get("stream", -1) >= number or batch.isEmpty():
            return
        batch = batch.persist()
        store.write(batch, order, stream=number)
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
