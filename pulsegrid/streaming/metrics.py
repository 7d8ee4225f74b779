"""Daily users and sessions over a stream of interactions. Late events are taken up to the watermark's delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.sessions import timeout_seconds
from pulsegrid.schema import SESSION_TIMEOUT_S


def daily_active(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Approximate users and exact interactions by day. Streams cannot count distinct exactly within bounded state."""
    day = F.window("timestamp", "1 day")
    out = stream.withWatermark("timestamp", delay).groupBy(day.alias("day")).agg(F.approx_count_distinct("user_id", 0.01).alias("daily_active_users"), F.count(F.lit(1)).alias("total_interactions"), F.sum("duration_ms").alias("total_duration_ms"))
    return out.select(F.to_date("day.start").alias("date"), "daily_active_users", "total_interactions", "total_duration_ms")


def sessions(stream: DataFrame, timeout: int | str = SESSION_TIMEOUT_S, delay: str = "1 hour") -> DataFrame:
    """Closed sessions, in append mode: a session comes out when the watermark has passed its end."""
    gap = timeout_seconds(timeout)
    grouped = stream.withWatermark("timestamp", delay).groupBy("user_id", F.session_window("timestamp", f"{gap} seconds").alias("w"))
    out = grouped.agg(F.count(F.lit(1)).alias("action_count"), F.sum("duration_ms").alias("total_action_duration_ms"))
    return out.select("user_id", F.col("w.start").alias("session_start_time"), F.col("w.end").alias("session_end_time"), "action_count", "total_action_duration_ms", (F.col("action_count") == 1).alias("is_bounce"))
