"""Structured Streaming sinks that keep a snapshot table up to date: upserts and retention per micro-batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.retention import Retention
from ..operators.writes import Conflict, upsert
from ..sources.snapshots import Snapshots


def upsert_stream(stream: DataFrame, store: Snapshots, table: str, conflict: Conflict, latest: str, checkpoint: str, retention: Retention | None = None, **trigger: Any):
    """Starts a stream whose rows are upserted into a table; of equal keys in a batch the one with the largest `latest` counts.

    A batch that is run again after a failure writes the same table once more.
    """

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.withColumn("__n", F.row_number().over(W.partitionBy(*conflict.keys).orderBy(F.col(latest).desc()))).where("__n = 1").drop("__n")
        new = upsert(store.read(table), newest, conflict).table
        store.write(table, retention.kept(new) if retention else new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
