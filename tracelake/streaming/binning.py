"""Binning of an unbounded stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bins(events: DataFrame, width: str, late: str, time: str = "ts", value: str = "value", key: str = "event_type") -> DataFrame:
    """Count, sum and mean of each key in tumbling windows, on a stream or a table.

    On a stream a window closes once the watermark has passed it by ``late``.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    source = events.withWatermark(time, late) if events.isStreaming else events
    got = source.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return got.select(F.col("window.start").alias("start"), key, "n", "total", "mean")
