"""The running error rate of an evaluation, as a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_rates(results: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, category, total, errors, error_rate) in windows of event time ``ts``; results later than ``late`` are left out.

    ``results`` has ts (timestamp), category and is_correct; it may be a stream or a table.
    """
    by = results.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "category")
    made = by.agg(F.count("*").alias("total"), F.count_if(~F.col("is_correct")).alias("errors"))
    return made.select(F.col("w.start").alias("start"), "category", "total", "errors", F.round(F.col("errors") / F.col("total"), 6).alias("error_rate"))


def start(results: DataFrame, name: str, checkpoint: str, **options: str):
    """A query that appends closed windows to the in-memory table ``name``; for tests and dashboards."""
    return error_rates(results, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()
