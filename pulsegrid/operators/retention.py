"""Cohort retention by calendar week or month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.schema import SEGMENTS, need


def _start(value: Column, period: str) -> Column:
    return F.date_trunc(period, value).cast("date")


def _since(cohort: Column, later: Column, period: str) -> Column:
    if period == "week":
        return F.floor(F.datediff(later, cohort) / 7).cast("int")
    return F.months_between(later, cohort).cast("int")


def _dense(activity: DataFrame, sizes: DataFrame, keys: list[str], periods: int, censor_after) -> DataFrame:
    """Every (cohort, 0 .. periods - 1), 0 where nothing was retained; null after ``censor_after`` if that is given."""
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("week_number"))
    out = grid.join(activity, [*keys, "week_number"], "left").withColumn("retained_users", F.coalesce("retained_users", F.lit(0)).cast("long"))
    if censor_after is not None:
        seen = F.date_add("cohort_week", F.col("week_number") * 7) <= F.lit(censor_after).cast("date")
        out = out.withColumn("retained_users", F.when(seen, F.col("retained_users")))
    return out.withColumn("retention_rate", F.try_divide(F.col("retained_users").cast("double"), F.col("cohort_size").cast("double")))


def cohort_retention(interactions: DataFrame, metadata: DataFrame, period: str = "week", periods: int = 26, censor_after=None) -> DataFrame:
    """cohort_week (first day), week_number, cohort_size, retained_users, retention_rate. Cohorts count all users of ``metadata``.

    A null registration date is a cohort of its own that retains nobody.
    """
    if period not in ("week", "month"):
        raise ValueError("period must be week or month")
    need(interactions, "user_id", "timestamp")
    need(metadata, "user_id", "registration_date")
    cohorts = metadata.select("user_id", _start(F.col("registration_date"), period).alias("cohort_week"))
    sizes = cohorts.groupBy("cohort_week").agg(F.count_distinct("user_id").alias("cohort_size"))
    # one row per user and period first: a user's thousands of events are not joined one by one
    seen = interactions.select("user_id", _start(F.col("timestamp"), period).alias("at")).distinct()
    n = _since(F.col("cohort_week"), F.col("at"), period)
    activity = seen.join(cohorts, "user_id").withColumn("week_number", n).filter((n >= 0) & (n < periods))
    activity = activity.groupBy("cohort_week", "week_number").agg(F.count_distinct("user_id").alias("retained_users"))
    return _dense(activity, sizes, ["cohort_week"], periods, censor_after).select("cohort_week", "week_number", "cohort_size", "retained_users", "retention_rate")


def cohort_retention_by_segment(interactions: DataFrame, metadata: DataFrame, segments: tuple[str, ...] = SEGMENTS, periods: int = 26, censor_after=None) -> DataFrame:
    """As ``cohort_retention`` for each value of each segment, with one pass over the interactions."""
    need(metadata, "user_id", "registration_date", *segments)
    pairs = F.array(*[F.struct(F.lit(s).alias("segment_type"), F.col(s).cast("string").alias("segment_value")) for s in segments])
    cohorts = metadata.select("user_id", _start(F.col("registration_date"), "week").alias("cohort_week"), F.inline(pairs))
    keys = ["cohort_week", "segment_type", "segment_value"]
    sizes = cohorts.groupBy(*keys).agg(F.count_distinct("user_id").alias("cohort_size"))
    seen = interactions.select("user_id", _start(F.col("timestamp"), "week").alias("at")).distinct()
    n = _since(F.col("cohort_week"), F.col("at"), "week")
    activity = seen.join(cohorts, "user_id").withColumn("week_number", n).filter((n >= 0) & (n < periods))
    activity = activity.groupBy(*keys, "week_number").agg(F.count_distinct("user_id").alias("retained_users"))
    return _dense(activity, sizes, keys, periods, censor_after).select("cohort_week", "week_number", "cohort_size", "retained_users", "retention_rate", "segment_type", "segment_value")


def average_curve(cohorts: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean retention over cohorts by week (and segment), in per cent."""
    return cohorts.groupBy("week_number", *by).agg(F.round(F.avg("retention_rate") * 100, 1).alias("avg_retention_pct"))


def mature_curve(cohorts: DataFrame, last_day, *by: str) -> DataFrame:
    """As ``average_curve``, over cohorts whose week lies before ``last_day`` only."""
    seen = F.date_add("cohort_week", F.col("week_number") * 7) <= F.lit(last_day).cast("date")
    return average_curve(cohorts.filter(seen), *by)


def weekly_drop(curve: DataFrame) -> DataFrame:
    """Change in points from one week to the next."""
    before = F.lag("avg_retention_pct").over(Window.orderBy("week_number"))  # one row per week
    return curve.withColumn("drop_pct", F.round(before - F.col("avg_retention_pct"), 1))


def activation_gap(interactions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Days from registration to the first event: users, activated within 7, 30 and 90 days, median, P75 and P90."""
    first = interactions.groupBy("user_id").agg(F.min(F.to_date("timestamp")).alias("first_day"))
    gap = metadata.join(first, "user_id").select(F.datediff("first_day", F.col("registration_date").cast("date")).alias("gap")).filter("gap >= 0")
    within = [F.count_if(F.col("gap") <= d).alias(f"within_{d}") for d in (7, 30, 90)]
    at = [F.percentile_approx("gap", p, 100_000).alias(n) for n, p in (("median_gap", 0.5), ("p75_gap", 0.75), ("p90_gap", 0.9))]
    return gap.agg(F.count(F.lit(1)).alias("users"), *within, *at)
