"""Incremental bilateral sums over a stream, an extra beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, time: str, keys: tuple[str, ...], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums and counts by keys and time window; rows later than ``late`` are ignored by a stream.

    The same plan runs on a static table.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "total", "n")


def upserts(sums: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends closed windows to a Parquet table."""
    return sums.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
