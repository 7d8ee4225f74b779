"""Sessions by inactivity gap, their frequency and bounce rates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import SESSION_TIMEOUT_S, need


def timeout_seconds(timeout: int | str) -> int:
    """A positive number of seconds, or ``"<n> second(s)"``."""
    if isinstance(timeout, bool) or not isinstance(timeout, int | str):
        raise ValueError(f"not a timeout: {timeout!r}")
    if isinstance(timeout, str):
        m = re.fullmatch(r"\s*(\d+)\s*seconds?\s*", timeout, re.IGNORECASE)
        if not m:
            raise ValueError(f"not a timeout: {timeout!r}")
        timeout = int(m[1])
    if timeout <= 0:
        raise ValueError("a timeout must be positive")
    return timeout


def session_metrics(interactions: DataFrame, timeout: int | str = SESSION_TIMEOUT_S) -> DataFrame:
    """One row for each user's run of events without a gap over ``timeout``; a gap equal to it stays inside.

    ``session_end_time`` is the last event plus the gap, ``last_event_time`` the event itself. A session of one action
    lasts that action's duration; others from first to last event, in whole seconds, plus the last action's
    duration. Other columns keep the value of the session's earliest event. Null timestamps have no session.
    """
    need(interactions, "user_id", "timestamp", "duration_ms")
    gap = timeout_seconds(timeout)
    fixed = {"user_id", "timestamp", "duration_ms", "session_id"}
    extra = sorted(c for c in interactions.columns if c not in fixed)
    grouped = interactions.groupBy("user_id", F.session_window("timestamp", f"{gap} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("action_count"), F.sum("duration_ms").alias("total_action_duration_ms"), F.avg("duration_ms").alias("avg_action_duration_ms"),
        F.min("timestamp").alias("_start"), F.max(F.struct("timestamp", "duration_ms")).alias("_last"), *[F.min_by(c, "timestamp").alias(c) for c in extra],
    )
    # not the window's ends: a filter on those would be pushed below the merging of events into sessions, and cut sessions short
    start, end = F.col("_start"), F.col("_last.timestamp") + F.expr(f"INTERVAL {gap} SECONDS")
    last = F.col("_last.duration_ms")
    span = (F.unix_timestamp(end) - F.unix_timestamp(start)) * 1000 - gap * 1000
    length = F.when(F.col("action_count") == 1, last.cast("long")).otherwise(span + last)
    return grouped.select(
        F.concat("user_id", F.lit("_"), F.date_format(start, "yyyyMMddHHmmss")).alias("session_id"), "user_id",
        start.alias("session_start_time"), end.alias("session_end_time"), F.col("_last.timestamp").alias("last_event_time"),
        "action_count", "total_action_duration_ms", "avg_action_duration_ms", last.alias("last_action_duration_ms"),
        length.alias("session_duration_ms"), (length / 1000.0).alias("session_duration_seconds"), (F.col("action_count") == 1).alias("is_bounce"), *extra,
    )


def session_frequency(sessions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each user: sessions, days with any, first and last day, sessions per active day; ``carry`` keeps the earliest session's values."""
    day = F.to_date("session_start_time")
    out = sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_distinct(day).alias("active_days"), F.min(day).alias("first_session_date"), F.max(day).alias("last_session_date"),
        *[F.min_by(c, "session_start_time").alias(c) for c in carry],
    )
    return out.withColumn("avg_sessions_per_day", F.coalesce(F.try_divide(F.col("total_sessions").cast("double"), "active_days"), F.lit(0.0)))



def _bounce_aggs() -> list:
    return [F.count(F.lit(1)).alias("total_sessions"), F.sum(F.col("is_bounce").cast("int").cast("long")).alias("bounced_sessions")]


def bounce_rate(sessions: DataFrame, *by: str) -> DataFrame:
    """Sessions of one action, in per cent; without keys one row, also for no sessions (rate 0)."""
    grouped = sessions.groupBy(*by).agg(*_bounce_aggs()) if by else sessions.agg(*_bounce_aggs())
    return grouped.withColumn("bounce_rate", F.coalesce(F.try_divide(F.col("bounced_sessions") * 100.0, "total_sessions"), F.lit(0.0)))


def bounce_rates(sessions: DataFrame, run_date, dimensions: tuple[str, ...] = ("device_type", "country")) -> DataFrame:
    """Overall (dated ``run_date``) and by day for each dimension, from one pass: sessions are expanded over the groupings, counts combined before the shuffle."""
    day = F.to_date("session_start_time")
    none = F.struct(F.lit(run_date).cast("date").alias("metric_date"), F.lit(None).cast("string").alias("dimension_name"), F.lit(None).cast("string").alias("dimension_value"))
    each = [F.struct(day.alias("metric_date"), F.lit(d).alias("dimension_name"), F.col(d).cast("string").alias("dimension_value")) for d in dimensions]
    out = sessions.select("is_bounce", F.inline(F.array(none, *each))).groupBy("metric_date", "dimension_name", "dimension_value").agg(*_bounce_aggs())
    return out.withColumn("bounce_rate", F.coalesce(F.try_divide(F.col("bounced_sessions") * 100.0, "total_sessions"), F.lit(0.0)))
