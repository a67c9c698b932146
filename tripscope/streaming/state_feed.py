"""Keeps a state table current from a stream of rows, one merge per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tripscope.sources.state import upsert


def upsert_stream(rows: DataFrame, path: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Each batch is reduced to its newest row per key and put into the table. A replayed batch puts the same rows again."""

    def put(batch: DataFrame, _epoch: int) -> None:
        upsert(batch, path, key, version)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
