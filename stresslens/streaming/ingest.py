"""Incremental forms: de-duplication under a watermark, daily counts, and appending what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(rows: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """A stream (or table) without repeats of ``keys`` that arrive within ``delay`` of each other."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(rows: DataFrame, ts: str, key: str, delay: str = "1 day") -> DataFrame:
    """Rows by day and key; on a stream a day is final once ``delay`` has passed."""
    timed = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return timed.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available to Parquet in append mode and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
