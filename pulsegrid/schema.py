"""Input schemas, their column lists, and the output tables' names."""

from __future__ import annotations

from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType, TimestampType

# The inputs' columns and the metric tables' names.
INTERACTIONS = StructType(
    [
        StructField("user_id", StringType(), False),
        StructField("timestamp", TimestampType(), False),
        StructField("action_type", StringType(), False),
        StructField("page_id", StringType(), False),
        StructField("duration_ms", IntegerType(), False),
        StructField("app_version", StringType(), False),
    ]
)
USERS = StructType(
    [
        StructField("user_id", StringType(), False),
        StructField("device_type", StringType(), False),
        StructField("country", StringType(), False),
        StructField("subscription_type", StringType(), False),
        StructField("registration_date", DateType(), True),
    ]
)
SEGMENTS = ("subscription_type", "device_type", "country")
METRIC_TABLES = (
    "daily_active_users", "monthly_active_users", "user_stickiness", "power_users", "cohort_retention", "cohort_retention_by_segment",
    "performance_by_version", "device_performance", "device_correlation", "performance_anomalies", "session_metrics", "session_frequency", "bounce_rates",
)
STAGING_TABLES = ("user_metadata", "user_interactions")
MAX_DURATION_MS, SESSION_TIMEOUT_S, JOB_SESSION_TIMEOUT_S = 28_800_000, 1800, 600
Z_CRITICAL, Z_HIGH, Z_MEDIUM = 4.0, 3.5, 3.0


def required(schema: StructType) -> list[str]:
    return schema.fieldNames()


def not_null(schema: StructType) -> list[str]:
    return [f.name for f in schema if not f.nullable]


def need(df, *columns: str) -> None:
    """ValueError that names the columns which are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
