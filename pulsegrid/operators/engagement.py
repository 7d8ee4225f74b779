"""Active users, stickiness and power users."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import CUTS, once, ranked
from pulsegrid.schema import MAX_DURATION_MS, need


def daily_active(interactions: DataFrame, approximate: bool = False) -> DataFrame:
    """A row for each day with events. Null ids count as interactions, not as users."""
    need(interactions, "user_id", "timestamp")
    distinct = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    out = interactions.groupBy(F.to_date("timestamp").alias("date")).agg(
        distinct.alias("daily_active_users"), F.count(F.lit(1)).alias("total_interactions"), F.sum("duration_ms").alias("total_duration_ms")
    )
    return out.withColumn("avg_duration_per_user", F.coalesce(F.try_divide(F.col("total_duration_ms").cast("double"), "daily_active_users"), F.lit(0.0)))


def monthly_active(interactions: DataFrame, approximate: bool = False) -> DataFrame:
    """A row for each calendar month with events, dated its first day."""
    need(interactions, "user_id", "timestamp")
    distinct = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return interactions.groupBy(F.trunc("timestamp", "month").alias("month")).agg(distinct.alias("monthly_active_users"), F.count(F.lit(1)).alias("total_interactions"))


def rolling_active(interactions: DataFrame, days: int = 30, min_events: int = 1) -> DataFrame:
    """For each day with events, the users with ``min_events`` or more in the ``days`` days up to it.

    For one event a user's day counts until the user's next day or until it is ``days`` old, so that it gives two steps of a running sum over
    dates. For more, a user's day is spread over the days that it counts for.
    """
    per = interactions.groupBy("user_id", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    if min_events <= 1:
        stop = F.least(F.date_add("day", days), F.lead("day").over(Window.partitionBy("user_id").orderBy("day")))
        known = F.when(F.col("user_id").isNotNull() & F.col("day").isNotNull(), 1).otherwise(0)
        ends = per.select("day", stop.alias("stop"), known.alias("one"))
        steps = ends.select(F.inline(F.array(F.struct(F.col("day").alias("date"), F.col("one").alias("step"), F.lit(1).alias("seen")), F.struct(F.col("stop").alias("date"), (-F.col("one")).alias("step"), F.lit(0).alias("seen")))))
        dates = steps.filter("date IS NOT NULL").groupBy("date").agg(F.sum("step").alias("step"), F.max("seen").alias("seen"))
        upto = F.sum("step").over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row per date
        return dates.withColumn("active_users", upto).filter("seen = 1").select("date", "active_users")
    spread = per.select("user_id", "n", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("date"))
    counted = spread.groupBy("date", "user_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_events)
    return counted.groupBy("date").agg(F.count("user_id").alias("active_users")).join(per.select(F.col("day").alias("date")).distinct(), "date", "left_semi")


def stickiness(dau: DataFrame, mau: DataFrame) -> DataFrame:
    """Average daily over monthly active users, over days present; null where the month has none."""
    avg = dau.groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("daily_active_users").alias("avg_dau"))
    return avg.join(mau.select("month", "monthly_active_users"), "month").withColumn("stickiness_ratio", F.try_divide("avg_dau", F.col("monthly_active_users").cast("double")))


def stickiness_daily(dau: DataFrame, mau: DataFrame) -> DataFrame:
    """Each day's users over its month's."""
    joined = dau.withColumn("month", F.trunc("date", "month")).join(mau.select("month", "monthly_active_users"), "month")
    return joined.select("date", F.col("daily_active_users").alias("dau"), F.col("monthly_active_users").alias("mau"), F.try_divide(F.col("daily_active_users").cast("double"), "monthly_active_users").alias("stickiness"))


def user_totals(interactions: DataFrame, max_duration_ms: int = MAX_DURATION_MS) -> DataFrame:
    pages = F.count_distinct("page_id") if "page_id" in interactions.columns else F.lit(None).cast("long")
    kept = interactions.filter(F.col("duration_ms") <= max_duration_ms)
    out = kept.groupBy("user_id").agg(
        F.sum("duration_ms").alias("total_duration_ms"), F.count(F.lit(1)).alias("total_interactions"),
        F.count_distinct(F.to_date("timestamp")).alias("days_active"), pages.alias("unique_pages"),
    )
    avg = F.col("total_duration_ms") / F.col("total_interactions")
    return out.withColumns({"hours_spent": F.col("total_duration_ms") / F.lit(3_600_000.0), "avg_duration_per_interaction": avg, "avg_duration_ms": avg})


def power_users(interactions: DataFrame, metadata: DataFrame | None = None, percentile: float = 0.99, max_duration_ms: int = MAX_DURATION_MS, most_ranked: int | None = None) -> DataFrame:
    """The max(1, n - ceil(percentile (n-1))) users with the most time, ties by user_id, with a rank and their metadata.

    Only users at or above an approximate cut, which lies below the exact one, are ranked, and those in ranges.
    ``most_ranked``: beyond so many power users ``percentile_rank`` is null.
    """
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must be within 0 and 1")
    need(interactions, "user_id", "timestamp", "duration_ms")
    totals = once(user_totals(interactions, max_duration_ms))
    low = max(0.0, percentile - 0.001)
    at = F.percentile_approx("total_duration_ms", [low + (1 - low) * i / CUTS for i in range(CUTS)], 10_000)
    n, points = totals.agg(F.count(F.lit(1)), at).head()  # in the driver, as another evaluation may give other points
    near = totals.filter(F.col("total_duration_ms") >= points[0]) if points else totals
    k = n if n <= 1 else max(1, n - math.ceil(percentile * (n - 1)))
    top = ranked(near, "total_duration_ms", "user_id", points=points or []).filter(F.col("_rank") <= k)
    if k <= 1:
        place = F.lit(100.0)
    elif most_ranked is not None and k > most_ranked:
        place = F.lit(None).cast("double")
    else:
        place = F.lit(100.0 * percentile) + (F.lit(k) - F.col("_rank")) / F.lit(k - 1) * F.lit((1 - percentile) * 100)
    out = top.withColumn("percentile_rank", place).drop("_n", "_rank")
    return out if metadata is None else out.join(metadata, "user_id", "left")
