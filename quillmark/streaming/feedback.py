"""Feedback counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def helpfulness(feedback: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Answers and helpful ones by window; works on a stream (with a watermark) and on a table."""
    rows = feedback.withColumn("at", F.timestamp_seconds("timestamp"))
    if feedback.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.count_if("was_helpful").alias("helpful")).select("w.start", "w.end", "n", "helpful")
