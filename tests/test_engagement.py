import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import engagement, retention

T0 = datetime(2024, 1, 1, 9)


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp, duration_ms long, page_id string")


def test_dau_counts_users_and_events(spark):
    rows = [("a", T0, 10, "p"), ("b", T0, 20, "p"), ("a", T0, 30, "p"), ("b", T0, 5, "q"), ("a", T0, 5, "q"), ("a", T0 + timedelta(days=1), 7, "p"), ("c", T0 + timedelta(days=1), 8, "p")]
    out = engagement.daily_active(events(spark, rows)).orderBy("date").collect()
    assert [(r.daily_active_users, r.total_interactions, r.total_duration_ms) for r in out] == [(2, 5, 70), (2, 2, 15)]
    assert out[0].avg_duration_per_user == 35.0


def test_dau_without_durations_is_zero_per_user(spark):
    out = engagement.daily_active(events(spark, [("a", T0, None, "p"), (None, T0, None, "p")])).head()
    assert (out.daily_active_users, out.total_interactions, out.avg_duration_per_user) == (1, 2, 0.0)


def test_dau_needs_its_columns(spark):
    with pytest.raises(ValueError, match="timestamp"):
        engagement.daily_active(spark.createDataFrame([("a",)], "user_id string"))


def test_stickiness_is_null_without_monthly_users(spark):
    dau = spark.createDataFrame([(date(2024, 1, 1), 10), (date(2024, 1, 2), 20), (date(2024, 2, 1), 5)], "date date, daily_active_users long")
    mau = spark.createDataFrame([(date(2024, 1, 1), 60), (date(2024, 2, 1), 0)], "month date, monthly_active_users long")
    out = {r.month.month: r.stickiness_ratio for r in engagement.stickiness(dau, mau).collect()}
    assert out == {1: 0.25, 2: None}


def test_power_users_top_percent(spark):
    rows = [(f"u{i:03d}", T0, i * 1000, "p") for i in range(1, 101)]
    out = engagement.power_users(events(spark, rows)).collect()
    assert [(r.user_id, r.percentile_rank) for r in out] == [("u100", 100.0)]


def test_power_users_ties_break_by_id_and_ranks_rise(spark):
    rows = [(u, T0, 100, "p") for u in "dcba"] + [("e", T0, 1, "p")]
    out = engagement.power_users(events(spark, rows), percentile=0.5).orderBy("percentile_rank").collect()
    assert [(r.user_id, r.percentile_rank) for r in out] == [("c", 50.0), ("b", 75.0), ("a", 100.0)]


def test_power_users_leave_out_long_and_missing_durations(spark):
    rows = [("a", T0, 5_000, "p"), ("a", T0, 120_000, "p"), ("a", T0, 50_000_000, "p"), ("a", T0, None, "p")]
    assert engagement.power_users(events(spark, rows)).head().total_duration_ms == 125_000
    with pytest.raises(ValueError):
        engagement.power_users(events(spark, rows), percentile=1.5)


def test_power_users_many_rows_match_exact_rank(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("user_id"), F.lit(T0).alias("timestamp"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("duration_ms"))
    got = {r.user_id for r in engagement.power_users(rows, percentile=0.95).collect()}
    pairs = sorted(((-r.duration_ms, r.user_id) for r in rows.collect()))
    assert got == {u for _, u in pairs[: 5000 - -(-95 * 4999 // 100)]}


def test_rolling_users(spark):
    rows = [("a", T0, 1, "p"), ("b", T0 + timedelta(days=2), 1, "p"), ("a", T0 + timedelta(days=5), 1, "p")]
    out = {r.date.day: r.active_users for r in engagement.rolling_active(events(spark, rows), days=3).collect()}
    assert out == {1: 1, 3: 2, 6: 1}


def cohort_input(spark, weeks):
    users = [(f"u{i}", date(2024, 1, 1)) for i in range(100)]
    rows = [(f"u{i}", T0 + timedelta(weeks=w), 1, "p") for w, n in enumerate(weeks) for i in range(n)]
    return events(spark, rows), spark.createDataFrame(users, "user_id string, registration_date date")


def test_retention_declines_and_grid_is_dense(spark):
    out = retention.cohort_retention(*cohort_input(spark, [100, 80, 60, 50]), periods=6).orderBy("week_number").collect()
    assert [r.retention_rate for r in out] == [1.0, 0.8, 0.6, 0.5, 0.0, 0.0]
    assert dict(retention.cohort_retention(*cohort_input(spark, [1])).dtypes)["week_number"] == "int"


def test_retention_return_after_gap_and_censoring(spark):
    i, u = cohort_input(spark, [100, 0, 40])
    assert [r.retained_users for r in retention.cohort_retention(i, u, periods=3).orderBy("week_number").collect()] == [100, 0, 40]
    cut = retention.cohort_retention(i, u, periods=4, censor_after="2024-01-16").orderBy("week_number").collect()
    assert [r.retained_users for r in cut] == [100, 0, 40, None]


def test_retention_null_registration_and_empty_events(spark):
    u = spark.createDataFrame([("a", None), ("b", date(2024, 1, 7))], "user_id string, registration_date date")
    out = retention.cohort_retention(events(spark, [("a", T0, 1, "p"), ("b", datetime(2024, 1, 8), 1, "p")]), u, periods=2).collect()
    assert {(r.cohort_week, r.week_number): r.retained_users for r in out} == {(None, 0): 0, (None, 1): 0, (date(2024, 1, 1), 0): 0, (date(2024, 1, 1), 1): 1}
    assert all(r.retained_users == 0 for r in retention.cohort_retention(events(spark, []), u, periods=2).collect())
    with pytest.raises(ValueError):
        retention.cohort_retention(events(spark, []), u, period="day")


def test_retention_by_segment(spark):
    i, u = cohort_input(spark, [100, 50])
    u = u.withColumns({"subscription_type": F.lit("free"), "device_type": F.when(F.col("user_id") < "u5", "x").otherwise("y"), "country": F.lit(None).cast("string")})
    out = retention.cohort_retention_by_segment(i, u, periods=1).collect()
    assert {(r.segment_type, r.segment_value): r.cohort_size for r in out} == {("subscription_type", "free"): 100, ("device_type", "x"): 45, ("device_type", "y"): 55, ("country", None): 100}


def test_power_users_when_approximate_quantiles_differ_between_evaluations(spark, monkeypatch):
    real = F.percentile_approx

    @F.udf("array<bigint>")
    def lowered(points):
        return [p - random.randint(0, 3000) for p in points]

    monkeypatch.setattr(F, "percentile_approx", lambda *a: lowered.asNondeterministic()(real(*a)))
    rows = [(f"u{i:04d}", T0, i * 1000, "p") for i in range(400)]
    out = engagement.power_users(events(spark, rows), None, 0.5).collect()
    assert {r.user_id: round(r.percentile_rank, 6) for r in out} == {f"u{400 - r:04d}": round(50 + (200 - r) / 199 * 50, 6) for r in range(1, 201)}
