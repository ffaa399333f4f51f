"""Snapshot sync as a stream of announcements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ANNOUNCEMENT = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)


def announce(spark: SparkSession, folder: str, snapshot_id: str, path: str) -> None:
    """Say that the snapshot at ``path`` is complete."""
    row = spark.createDataFrame([(snapshot_id, path)], ANNOUNCEMENT)
    row.coalesce(1).write.mode("append").json(folder)


def sync_stream(
    spark: SparkSession,
    announcements: str,
    checkpoint: str,
    sync: Callable[[str, str], object],
) -> StreamingQuery:
    """Run ``sync(snapshot_id, path)`` for each announced snapshot, in order.

    The stream carries one small row per snapshot, not its rows: deletes are told
    by absence, so a snapshot must be seen whole, and it is read in parallel from
    its folder. A repeated micro-batch is harmless, because ``sync`` skips
    snapshots that are already published. Stops when all announcements are read.
    """

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("snapshot_id").toLocalIterator():
            sync(row["snapshot_id"], row["path"])

    return (
        spark.readStream.schema(ANNOUNCEMENT)
        .option("maxFilesPerTrigger", 1)
        .json(announcements)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(run)
        .start()
    )
