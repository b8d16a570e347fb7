"""Streaming forms: suppression windows and spike sessions over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rms_windows(stream: DataFrame, window: str = "500 milliseconds", threshold: float = 10, late: str = "10 seconds") -> DataFrame:
    """Tumbling windows of (recording_id, ts, v) with their RMS and whether it is below the threshold."""
    x = stream.withWatermark("ts", late).groupBy("recording_id", F.window("ts", window).alias("w")).agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"))
    return x.select("recording_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", (F.col("rms") < threshold).alias("suppressed"))


def spike_sessions(stream: DataFrame, limit: float, gap: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of samples beyond the limit, per channel."""
    x = stream.withWatermark("ts", late).where(F.abs("v") > limit)
    x = x.groupBy("recording_id", "label", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("amplitude"))
    return x.select("recording_id", "label", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "amplitude")
