"""Metrics of an event stream: windowed counts and means under a watermark. The same plan serves a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """start, key, n, mean of each window and key; on a stream, events later than `late` are left out and state is dropped."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def to_parquet(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows appended to a folder; the checkpoint lets a restarted query go on where it was."""
    return metrics.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
