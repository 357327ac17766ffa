"""Usage of models over time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(calls: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Calls, tokens and errors of each model in windows of time; on a stream, windows end and rows go out once `late` has passed."""
    calls = calls.withWatermark("ts", late) if calls.isStreaming else calls
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return calls.groupBy(window.alias("w"), "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"), F.count("error").alias("errors")).select(F.col("w.start").alias("start"), "model", "calls", "tokens", "errors")


def usage_sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls and tokens of each image in sessions, which end where nothing comes for `gap`."""
    calls = calls.withWatermark("ts", late) if calls.isStreaming else calls
    return calls.groupBy(F.session_window("ts", gap).alias("w"), "image").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens")).select("image", F.col("w.start").alias("start"), "calls", "tokens")
