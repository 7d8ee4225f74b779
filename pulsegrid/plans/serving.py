"""Dashboard queries over the metric tables. ``as_of`` stands for the current date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.buckets import action_bucket, duration_bucket, share


def since(df: DataFrame, col: str, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col(col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def filtered(df: DataFrame, time: str | None = None, as_of: str | None = None, days: int = 30, **chosen) -> DataFrame:
    """A dashboard's filters on one of its tables: the last ``days`` by the column ``time``, and for each named column a value or several. None chooses all."""
    if time is not None:
        df = since(df, time, as_of, days)
    for column, value in chosen.items():
        if value is not None:
            df = df.filter(F.col(column).isin(*value) if isinstance(value, list | tuple | set) else F.col(column) == value)
    return df


def dau_series(dau: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return since(dau, "date", as_of, days).select("date", F.col("daily_active_users").alias("dau"), "total_interactions").orderBy("date")


def stickiness_recent(daily: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return since(daily, "date", as_of, days).agg(F.round(F.avg("stickiness"), 6).alias("avg_stickiness"))


def stickiness_trend(daily: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return since(daily, "date", as_of, days).select("date", "stickiness", "dau", "mau").orderBy("date")


def count_by(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("user_count")).orderBy(F.desc("user_count"), key)
    return out.limit(top) if top else out


def mau_recent(mau: DataFrame, months: int = 12) -> DataFrame:
    return mau.select(F.date_format("month", "yyyy-MM").alias("year_month"), F.col("monthly_active_users").alias("mau"), "total_interactions").orderBy(F.desc("year_month")).limit(months)


def engagement_summary(dau: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(dau, "date", as_of, days).agg(
        F.avg("daily_active_users").alias("avg_daily_active_users"), F.avg("total_interactions").alias("avg_daily_interactions"), (F.sum("total_duration_ms") / 1000 / 60).alias("total_minutes")
    )


def cohort_heatmap(cohorts: DataFrame, weeks: int = 26) -> DataFrame:
    return cohorts.filter(F.col("week_number") <= weeks).select("cohort_week", "week_number", "retention_rate", "cohort_size", "retained_users").orderBy(F.desc("cohort_week"), "week_number")


def retention_heatmap(cohorts: DataFrame) -> DataFrame:
    return cohorts.select(F.col("cohort_week").cast("string").alias("cohort_week"), "week_number", F.round(F.col("retention_rate") * 100, 1).alias("retention_pct"))


def power_user_table(power: DataFrame, top: int = 100) -> DataFrame:
    cols = ["user_id", "total_interactions", F.col("hours_spent").alias("total_duration_hours"), F.round(F.col("avg_duration_ms") / 1000, 2).alias("avg_seconds"), "country", "device_type", "subscription_type", "registration_date"]
    return power.orderBy(F.desc("hours_spent"), "user_id").limit(top).select(*cols)


def engagement_hours(power: DataFrame) -> DataFrame:
    return power.select(F.col("hours_spent").alias("total_duration_hours"))


def latest_curves(cohorts: DataFrame, latest: int = 10, weeks: int = 12) -> DataFrame:
    newest = cohorts.select("cohort_week").distinct().orderBy(F.desc("cohort_week")).limit(latest)
    return cohorts.join(F.broadcast(newest), "cohort_week", "left_semi").filter(F.col("week_number") <= weeks).select("cohort_week", "week_number", "retention_rate")


def retention_at(cohorts: DataFrame, weeks: tuple[int, ...] = (0, 12)) -> DataFrame:
    return cohorts.filter(F.col("week_number").isin(*weeks)).groupBy("week_number").agg(F.round(F.avg("retention_rate"), 9).alias("avg_retention"))


def retention_quarter(cohorts: DataFrame, weeks: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    quarter = F.concat(F.lit("Q"), F.quarter("cohort_week").cast("string"), F.lit(" "), F.year("cohort_week").cast("string"))
    return cohorts.filter(F.col("week_number").isin(*weeks)).groupBy(quarter.alias("registration_quarter"), "week_number").agg(F.round(F.avg("retention_rate") * 100, 1).alias("avg_retention_pct"))


def retention_kpi(cohorts: DataFrame, plateau: int = 7) -> DataFrame:
    pct = F.col("retention_rate") * 100
    at = lambda c: F.round(F.avg(F.when(c, pct)), 1)
    return cohorts.agg(at(F.col("week_number") == 0).alias("w0_pct"), at(F.col("week_number") == 1).alias("w1_pct"), at(F.col("week_number") >= plateau).alias("plateau_pct"))


def retention_top_countries(by_segment: DataFrame, top: int = 5) -> DataFrame:
    """The average curve of each of the countries with the most users; ties by name."""
    rows = by_segment.filter("segment_type = 'country'")
    most = rows.filter("week_number = 0").groupBy("segment_value").agg(F.sum("cohort_size").alias("users")).orderBy(F.desc("users"), "segment_value").limit(top)
    kept = rows.join(F.broadcast(most.select("segment_value")), "segment_value", "left_semi")
    return kept.groupBy("week_number", F.col("segment_value").alias("country")).agg(F.round(F.avg("retention_rate") * 100, 1).alias("avg_retention_pct"))


def anomaly_consensus(z_scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Both methods' anomalies in one table: app_version, metric_date, method and signal (a severity, or a distance)."""
    a = z_scores.select("app_version", "metric_date", F.lit("z_score").alias("method"), F.col("severity").alias("signal"))
    return a.unionByName(clusters.select("app_version", "metric_date", F.lit("kmeans").alias("method"), F.round("centroid_distance", 2).cast("string").alias("signal")))


def hours_by_subscription(power: DataFrame) -> DataFrame:
    return power.groupBy("subscription_type").agg(F.round(F.avg("hours_spent"), 9).alias("avg_hours"), F.count(F.lit(1)).alias("user_count"))


def version_series(perf: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(perf, "metric_date", as_of, days).select("metric_date", "app_version", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms", F.col("count").alias("total_interactions")).orderBy(F.desc("metric_date"), "app_version")


def latency_gap(perf: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(perf, "metric_date", as_of, days).select("metric_date", "app_version", (F.col("p99_duration_ms") - F.col("p50_duration_ms")).alias("latency_gap"))


def version_heatmap(perf: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return since(perf, "metric_date", as_of, days).select("metric_date", "app_version", "p95_duration_ms")


def device_comparison(device: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return since(device, "metric_date", as_of, days).groupBy("device_type").agg(
        F.round(F.avg("avg_duration_ms"), 4).alias("avg_load_time"), F.round(F.avg("p95_duration_ms"), 4).alias("p95_load_time"), F.sum("count").alias("total_interactions")
    )


def device_table(correlation: DataFrame, with_anova: bool = False) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    more = [r("f_statistic", 4), r("eta_squared", 4)] if with_anova else []
    return correlation.select("device_type", r("avg_duration_ms", 2), r("p95_duration_ms", 2), "total_interactions", "unique_users", r("interactions_per_user", 2), *more)


def alerts(report: DataFrame, as_of: str, days: int = 7, top: int = 50) -> DataFrame:
    recent = since(report, "detected_at", as_of, days)
    cols = ["severity", "app_version", "device_type", "metric_name", F.round("metric_value", 2).alias("value"), F.round("z_score", 2).alias("z_score"), "description"]
    return recent.orderBy(F.desc("detected_at"), F.desc("severity"), "app_version", "metric_date").limit(top).select(F.date_format("detected_at", "yyyy-MM-dd HH:mm").alias("detected_time"), *cols)


def critical_count(report: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    return since(report, "detected_at", as_of, days).agg(F.count_if(F.col("severity") == "critical").alias("critical_anomalies"))


def duration_buckets(sessions: DataFrame) -> DataFrame:
    out = sessions.groupBy(duration_bucket(F.col("session_duration_ms")).alias("duration_bucket")).agg(F.count(F.lit(1)).alias("session_count"))
    return out.withColumn("percentage", share(F.col("session_count"), F.sum("session_count").over(Window.partitionBy(F.lit(0)))))  # five rows


def action_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(action_bucket(F.col("action_count")).alias("action_bucket")).agg(F.count(F.lit(1)).alias("session_count"))


def bounce_by(rates: DataFrame, dimension: str) -> DataFrame:
    return rates.filter(F.col("dimension_name") == dimension).groupBy(F.col("dimension_value").alias(dimension)).agg(
        F.round(F.avg("bounce_rate"), 6).alias("avg_bounce_rate"), F.sum("total_sessions").alias("total_sessions"), F.sum("bounced_sessions").alias("bounced_sessions")
    )


def bounce_trend(rates: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(rates.filter("dimension_name IS NULL"), "metric_date", as_of, days).select("metric_date", "bounce_rate", "total_sessions", "bounced_sessions")


def bounce_recent(rates: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return bounce_trend(rates, as_of, days).agg(F.avg("bounce_rate").alias("overall_bounce_rate"))


def duration_by_device(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("device_type").agg(
        F.round(F.avg("session_duration_ms") / 1000, 6).alias("avg_duration_seconds"), F.round(F.avg("action_count"), 6).alias("avg_actions"), F.count(F.lit(1)).alias("session_count")
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"), F.round(F.avg("session_duration_ms") / 1000, 2).alias("avg_duration_sec"), F.round(F.avg("action_count"), 2).alias("avg_actions_per_session"),
        share(F.count_if("is_bounce"), F.count(F.lit(1))).alias("bounce_rate_pct"),
    )


def action_sample(sessions: DataFrame, most: int = 50, rows: int = 10_000) -> DataFrame:
    return sessions.filter(F.col("action_count") <= most).select("action_count").limit(rows)


def session_sample(frequency: DataFrame, most: int = 100, rows: int = 10_000) -> DataFrame:
    return frequency.filter(F.col("total_sessions") <= most).select("total_sessions").limit(rows)


def frequency_by_device_country(frequency: DataFrame, top: int = 100) -> DataFrame:
    n, again = F.count(F.lit(1)), F.count_if(F.col("total_sessions") > 1)
    return frequency.groupBy("device_type", "country").agg(
        n.alias("user_count"), F.round(F.avg("total_sessions"), 2).alias("avg_sessions_per_user"), F.round(F.avg("active_days"), 2).alias("avg_active_days"),
        F.round(F.avg("avg_sessions_per_day"), 2).alias("avg_sessions_per_day"), again.alias("return_users"), share(again, n).alias("return_rate"),
    ).orderBy(F.desc("user_count"), "device_type", "country").limit(top)


def chart_kpis(dau: DataFrame, mau: DataFrame, sticky: DataFrame) -> DataFrame:
    """The exported single-number charts in one row."""
    a = dau.agg(F.round(F.avg("avg_duration_per_user") / 60000, 6).alias("engaged_minutes_per_user"), (F.sum("total_interactions") / F.sum("daily_active_users")).alias("interactions_per_user"), F.avg("daily_active_users").alias("avg_dau"))
    b = mau.agg(F.avg("monthly_active_users").alias("avg_mau"))
    c = sticky.agg(F.round(F.max("stickiness_ratio"), 9).alias("max_stickiness"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def dau_rolling(dau: DataFrame, days: int = 7) -> DataFrame:
    """A line with its mean over the last ``days`` calendar days. One row per day."""
    w = Window.orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    return dau.select("date", "daily_active_users", F.round(F.avg("daily_active_users").over(w), 6).alias("rolling_mean"))


def device_share(device: DataFrame) -> DataFrame:
    out = device.groupBy("device_type").agg(F.sum("user_count").alias("user_count"))
    return out.withColumn("contribution_pct", share(F.col("user_count"), F.sum("user_count").over(Window.partitionBy(F.lit(0)))))
