"""Structured Streaming into an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscan.engine import SearchEngine


def ingest(records: DataFrame, engine: SearchEngine, checkpoint: str, trigger: dict | None = None, order: Sequence[str] = ()) -> StreamingQuery:
    """Upsert each micro-batch of ``records`` and commit it; of a batch's records with one id the last by ``order`` holds.

    A batch that was committed before a restart isn't written again."""

    def write(batch: DataFrame, number: int) -> None:
        store = engine._store
        last = store.last_batch()
        if last is not None and number <= last:
            return
        store.upsert(batch, order)
        store.commit(batch=number)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
