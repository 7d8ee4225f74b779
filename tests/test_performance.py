from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import performance


def test_percentiles_within_one_percent(spark):
    df = spark.range(1, 10_001).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("v"))
    r = performance.percentiles(df, "v", ["g"]).head()
    assert r["count"] == 10_000 and abs(r.p50 - 5000) <= 50 and abs(r.p95 - 9500) <= 95 and abs(r.p99 - 9900) <= 99


def test_correlation_p95_is_exact(spark):
    n = 300_000
    v = ((F.col("id") * 7919) % n + 1).cast("int").alias("duration_ms")  # 7919 is prime to n
    rows = spark.range(n, numPartitions=7).select(F.lit("g").alias("device_type"), v, F.lit("u").alias("user_id"))
    assert performance.device_correlation(rows).head().p95_duration_ms == 285_000


def test_percentiles_are_exact(spark):
    n = 300_000
    df = spark.range(n, numPartitions=7).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n + 1).cast("int").alias("v"))  # 7919 is prime to n
    r = performance.percentiles(df, "v", ["g"], (0.5, 0.95, 0.99, 0.999)).head()
    assert r[4:] == (150_000, 285_000, 297_000, 299_700)
    rows = df.select(F.col("g").alias("device_type"), F.col("v").alias("duration_ms"), F.lit("u").alias("user_id"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    assert performance.device_performance(rows).head().p95_duration_ms == 285_000


def test_percentiles_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, None), ("a", None), ("b", 5)], "g string, v int")
    got = {r.g: (r["count"], r.p0, r.p50, r.p100) for r in performance.percentiles(df, "v", ["g"], (0.0, 0.5, 1.0)).collect()}
    assert got == {None: (3, 1, 1, 2), "a": (1, None, None, None), "b": (1, 5, 5, 5)}
    assert performance.percentiles(df, "v", [], (0.5,)).collect()[0].p50 == 2


def test_percentile_names_do_not_collide(spark):
    df = spark.createDataFrame([("g", 1)], "g string, v int")
    assert performance.percentiles(df, "v", ["g"], (0.29, 0.57, 0.99, 0.999)).columns[-4:] == ["p29", "p57", "p99", "p99_9"]
    with pytest.raises(ValueError):
        performance.percentiles(df, "v", ["g"], (1.1,))


def test_correlation_matches_textbook_anova(spark):
    groups = {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]}
    rows = [(f"{g}{i}", g, v) for g, x in groups.items() for i, v in enumerate(x)]
    out = performance.device_correlation(spark.createDataFrame(rows, "user_id string, device_type string, duration_ms long")).collect()
    assert [r.device_type for r in out] == ["c", "b", "a"]
    assert out[0].f_statistic == pytest.approx(13.0) and out[0].eta_squared == pytest.approx(26 / 32)


def test_correlation_edge_cases(spark):
    empty = spark.createDataFrame([], "user_id string, device_type string, duration_ms long")
    assert performance.device_correlation(empty).count() == 0
    one = spark.createDataFrame([("u", "a", None), ("v", "a", None)], "user_id string, device_type string, duration_ms long")
    r = performance.device_correlation(one).head()
    assert r.f_statistic is None and r.total_interactions == 2
    with pytest.raises(ValueError):
        performance.device_correlation(one.drop("device_type"))


def daily(spark, values, version="1"):
    return [(version, date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]


def test_anomalies_two_high_days(spark):
    rows = daily(spark, [900 + 7 * (i % 28) for i in range(28)] + [5000, 6000])
    df = spark.createDataFrame(rows, "app_version string, metric_date date, v double")
    out = performance.anomalies(df, "v").collect()
    assert sorted(r.v for r in out) == [5000.0, 6000.0] and {r.anomaly_type for r in out} == {"high"}
    assert performance.anomalies(df, "v").columns == ["app_version", "metric_date", "v", "baseline_mean", "baseline_stddev", "z_score", "anomaly_type"]


def test_anomalies_by_group_and_null_keys(spark):
    rows = daily(spark, [1000 + i % 3 for i in range(28)] + [9000], "a") + daily(spark, [1000 + i % 3 for i in range(29)], "b") + daily(spark, [1, 2, 900], None)
    df = spark.createDataFrame(rows, "app_version string, metric_date date, v double")
    assert [(r.app_version, r.v) for r in performance.anomalies(df, "v", by=["app_version"]).collect()] == [("a", 9000.0)]


def test_constant_values_have_no_anomalies(spark):
    df = spark.createDataFrame(daily(spark, [5, 5, 5]), "app_version string, metric_date date, v double")
    assert performance.anomalies(df, "v", 0.1).count() == 0


def test_severity(spark):
    df = spark.createDataFrame([(z,) for z in (-4.2, 3.6, 3.0, 1.0)], "z double")
    assert [r.s for r in df.select(performance.severity(F.col("z")).alias("s")).collect()] == ["critical", "high", "medium", "low"]
