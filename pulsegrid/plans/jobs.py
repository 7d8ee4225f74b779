"""The four batch jobs as functions from frames to named metric tables, and a command line.

    python -m pulsegrid.plans.jobs process --interactions i.csv --metadata m.csv --output out
    python -m pulsegrid.plans.jobs engagement --input out/enriched_interactions --output metrics
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import monitoring, schema, session
from pulsegrid.functions.buckets import duration_bucket, effect_size
from pulsegrid.operators import checks, engagement, joins, performance, retention, sessions
from pulsegrid.sources import files, jdbc

log = logging.getLogger(__name__)
TABLES = {t: t for t in (*schema.METRIC_TABLES, *schema.STAGING_TABLES)}


def process(interactions: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """Enriched interactions with processing time and date, and the inputs as staging tables. Null required values are logged, not dropped."""
    for name, df, want in (("interactions", interactions, schema.INTERACTIONS), ("metadata", metadata, schema.USERS)):
        for warning in checks.validate(df, schema.required(want), schema.not_null(want), want):
            log.warning("%s: %s", name, warning)
    enriched = joins.enrich(interactions, metadata).withColumn("processing_timestamp", F.current_timestamp())
    return {"enriched_interactions": enriched, "user_interactions": interactions, "user_metadata": metadata}


def users_of(enriched: DataFrame) -> DataFrame:
    return enriched.select(schema.required(schema.USERS)).distinct()


def engage(enriched: DataFrame) -> dict[str, DataFrame]:
    users = users_of(enriched)
    dau, mau = engagement.daily_active(enriched), engagement.monthly_active(enriched)
    return {
        "daily_active_users": dau,
        "monthly_active_users": mau,
        "user_stickiness": engagement.stickiness(dau, mau),
        "power_users": engagement.power_users(enriched, users),
        "cohort_retention": retention.cohort_retention(enriched, users),
        "cohort_retention_by_segment": retention.cohort_retention_by_segment(enriched, users),
    }


def perform(enriched: DataFrame, z: float = 3.0) -> dict[str, DataFrame]:
    """Null required values are logged, not dropped; a missing column raises."""
    for warning in checks.validate(enriched, ["user_id", "timestamp", "duration_ms", "app_version", "device_type"], ["duration_ms", "app_version"]):
        log.warning("performance: %s", warning)
    by_version = performance.named_percentiles(enriched.withColumn("metric_date", F.to_date("timestamp")), "duration_ms", ["app_version", "metric_date"])
    return {
        "performance_by_version": by_version,
        "device_performance": performance.device_performance(enriched),
        "device_correlation": performance.device_correlation(enriched),
        "performance_anomalies": performance.anomaly_report(by_version, "avg_duration_ms", z, ["app_version"]),
    }


def sessionize(enriched: DataFrame, timeout: int | str = schema.JOB_SESSION_TIMEOUT_S, run_date=None) -> dict[str, DataFrame]:
    kept = enriched.select("user_id", "timestamp", "duration_ms", "device_type", "country")
    found = sessions.session_metrics(kept, timeout)
    table = found.select("session_id", "user_id", "session_start_time", "session_end_time", "session_duration_ms", F.col("action_count").alias("actions_count"), "avg_action_duration_ms", F.col("is_bounce").cast("int").alias("is_bounce"), "device_type", "country")
    day = F.current_date() if run_date is None else F.lit(run_date).cast("date")
    rates = sessions.bounce_rates(found, None).withColumn("metric_date", F.when(F.col("dimension_name").isNull(), day).otherwise(F.col("metric_date")))
    return {"session_metrics": table, "session_frequency": sessions.session_frequency(found, ("device_type", "country")), "bounce_rates": rates}


# --- summaries -------------------------------------------------------------------------------------


def distribution(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(top)


def dau_summary(dau: DataFrame) -> DataFrame:
    return dau.agg(F.avg("daily_active_users").alias("avg_dau"), F.max("daily_active_users").alias("max_dau"), F.min("daily_active_users").alias("min_dau"))


def retention_summary(cohorts: DataFrame) -> DataFrame:
    at = lambda w: F.round(F.avg(F.when(F.col("week_number") == w, F.col("retention_rate"))), 9).alias(f"w{w}")
    return cohorts.agg(at(0), at(12))


def anova_summary(correlation: DataFrame) -> DataFrame:
    return correlation.agg(F.first("f_statistic").alias("f_statistic"), F.first("eta_squared").alias("eta_squared")).withColumn("effect", effect_size(F.col("eta_squared")))


def session_lengths(table: DataFrame) -> DataFrame:
    return table.groupBy(duration_bucket(F.col("session_duration_ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"))


def return_rate(frequency: DataFrame) -> DataFrame:
    return frequency.agg(F.count_if(F.col("total_sessions") > 1).alias("return_users"), F.round(F.try_divide(F.count_if(F.col("total_sessions") > 1) * 100.0, F.count(F.lit(1))), 2).alias("return_rate"))


#: job: title, the table that it is about, and how it is summed up
SUMMARIES = {
    "process": [("actions", "enriched_interactions", lambda df: distribution(df, "action_type")), ("devices", "enriched_interactions", lambda df: distribution(df, "device_type"))],
    "engagement": [("daily active users", "daily_active_users", dau_summary), ("retention", "cohort_retention", retention_summary)],
    "performance": [("devices", "device_correlation", anova_summary), ("anomalies", "performance_anomalies", lambda df: distribution(df, "severity"))],
    "sessions": [("lengths", "session_metrics", session_lengths), ("countries", "session_frequency", lambda df: distribution(df, "country", 5)), ("return", "session_frequency", return_rate)],
}


def summarize(job: str, tables: dict[str, DataFrame]) -> list[str]:
    """Lines of the job's summary; every table in it has a few rows."""
    lines = []
    for title, table, f in SUMMARIES[job]:
        for row in f(tables[table]).collect():
            lines.append(f"{job}, {title}: " + ", ".join(f"{k} {v}" for k, v in row.asDict().items()))
    return lines


# --- command line ----------------------------------------------------------------------------------

JOBS = {"engagement": engage, "performance": perform, "sessions": sessionize}
PROFILE = {"process": "etl"}


def _run(spark: SparkSession, args: argparse.Namespace) -> tuple[dict[str, DataFrame], list[monitoring.Observation]]:
    """The job's tables, and what its inputs show when an action has run over them."""
    if args.job == "process":
        a, seen = monitoring.observed(files.read_csv(spark, args.interactions, schema.INTERACTIONS), schema.not_null(schema.INTERACTIONS), ["duration_ms"])
        return process(a, files.read_csv(spark, args.metadata, schema.USERS)), [seen]
    df, seen = monitoring.observed(files.read_parquet(spark, args.input), ["user_id", "timestamp"], ["duration_ms"])
    df.agg(F.count(F.lit(1))).collect()  # fills the observation in one pass over its columns; tables then read what they need
    return JOBS[args.job](files.read_parquet(spark, args.input)), [seen]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the job succeeded, else 1."""
    parser = argparse.ArgumentParser(prog="pulsegrid")
    parser.add_argument("job", choices=["process", *JOBS])
    for name in ("interactions", "metadata", "input", "output"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--to-database", action="store_true")
    parser.add_argument("--dev-mode", action="store_true", help="log a summary of the tables")
    parser.add_argument("--profile", default="standard", choices=monitoring.PROFILES)
    parser.add_argument("--size-gb", type=float, default=1.0)
    args = parser.parse_args(argv)
    own = spark is None
    spark = spark or session.create_session(f"pulsegrid-{args.job}")
    how = monitoring.profile(args.profile)
    try:
        session.configure_job(spark, PROFILE.get(args.job, "analytics"), args.size_gb)
        ctx = monitoring.context(spark.sparkContext, args.job)
        tables, seen = _run(spark, args)
        if args.dev_mode:
            for line in summarize(args.job, tables):
                log.info(line)
        if args.to_database:
            jdbc.write_tables(tables, TABLES)
        if args.output:
            chosen = {k: v for k, v in tables.items() if k not in schema.STAGING_TABLES}
            files.write_tables(chosen, args.output, {"enriched_interactions": ["date"]})
        if args.dev_mode or args.to_database or args.output or args.job != "process":  # else no action has read the input
            for x in seen:
                monitoring.record(ctx, x, how)
        log.info(monitoring.summary(ctx, how["skew_threshold"]))
        return 0
    except Exception:
        log.exception("job %s failed", args.job)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
