"""The download queue as a stream: songs that arrive are merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators.store import Store


def ingest_stream(tracks: DataFrame, store: Store, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Upserts a streaming frame of song rows (with the order column ``order``) into the store's songs; runs what is available, then stops."""

    def merge(batch: DataFrame, number: int) -> None:
        store.merge("songs", batch.withColumn("status", F.lit("queued")), order)

    return tracks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
