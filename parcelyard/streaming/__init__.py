"""Event-time views of the observation stream, for results that must follow arriving rows.

The batch operators take a micro-batch as they take a table; what differs is state, which watermarks bound here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, parcel, metabolite, mean, n) of a stream of (ts, parcel, metabolite, value); rows later than ``late`` are dropped, as the watermark says."""
    w = F.window("ts", window)
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "parcel", "metabolite").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "parcel", "metabolite", "mean", "n")
