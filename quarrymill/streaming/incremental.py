"""Structured Streaming forms of batch operators (an extension: the batch forms define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def digest_stream(events: DataFrame, by: str, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per value and event-time window; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def distinct_stream(rows: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def apply_changes(files: DataFrame, state_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of (relpath, hash) to a log of versions; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("relpath", "hash").dropDuplicates(["relpath", "hash"]).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id:012d}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(log: DataFrame) -> DataFrame:
    """The newest hash of each path in a log of versions."""
    return log.groupBy("relpath").agg(F.max_by("hash", "batch").alias("hash"))
