"""Percentiles, one-way analysis of variance across devices, and two-pass z-score anomalies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.schema import Z_CRITICAL, Z_HIGH, Z_MEDIUM, need


def percentile_name(p: float) -> str:
    """0.95: p95; 0.999: p99_9."""
    text = f"{p * 100:.6f}".rstrip("0").rstrip(".")
    return "p" + text.replace(".", "_")


def exact_percentiles(df: DataFrame, value: str, by: list[str], at: tuple[float, ...]) -> DataFrame:
    """Keys and an array ``_p``: for each of ``at`` the least value that this share of the group's values does not exceed. Null values do not count; a group of nulls has no row.

    Equal values are counted before they are put in order, so a group's task sorts its distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_of": F.sum("_n").over(group)})
    # decimal, as 0.95 n in binary can pass the whole number that it is
    found = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_of") * F.lit(Decimal(str(float(p))))), F.col("_v"))) for p in at]
    return placed.groupBy(*by).agg(F.array(*found).alias("_p"))


def with_percentiles(grouped: DataFrame, df: DataFrame, value: str, by: list[str], at: tuple[float, ...]) -> DataFrame:
    """``grouped``, which has a row for each group of ``df`` by ``by``, with the groups' ``_p``. Null keys are groups too."""
    both = grouped.unionByName(exact_percentiles(df, value, by, at), allowMissingColumns=True)  # at most two rows a group
    return both.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*grouped.columns, "_p"] if c not in by])


def percentiles(df: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99), **more: Column) -> DataFrame:
    """Keys, count (rows, nulls included), mean, sample deviation, exact percentiles and ``more`` aggregates."""
    need(df, value, *by)
    if any(not 0 <= p <= 1 for p in at):
        raise ValueError("percentiles must be within 0 and 1")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias(f"avg_{value}"), F.stddev_samp(value).alias(f"stddev_{value}"), *[c.alias(n) for n, c in more.items()])
    out = with_percentiles(out, df, value, by, at)
    return out.select(*by, "count", f"avg_{value}", f"stddev_{value}", *[F.col("_p")[i].alias(percentile_name(p)) for i, p in enumerate(at)], *more)


def named_percentiles(df: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99), **more: Column) -> DataFrame:
    out = percentiles(df, value, by, at, **more)
    return out.withColumnsRenamed({percentile_name(p): f"{percentile_name(p)}_{value}" for p in at})


def device_performance(df: DataFrame) -> DataFrame:
    """Percentiles by device and day with the number of users."""
    day = F.to_date("timestamp").alias("metric_date")
    rows = df.select("device_type", day, "duration_ms", "user_id")
    return named_percentiles(rows, "duration_ms", ["device_type", "metric_date"], user_count=F.count_distinct("user_id"))


def device_correlation(interactions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Per device: mean, p95, interactions, users; F statistic and eta squared of a one-way ANOVA on every row; highest mean first.

    Group sizes in the ANOVA count non-null durations only. The sums run over the one row per device.
    """
    if "device_type" not in interactions.columns:
        if metadata is None:
            raise ValueError("device_type is neither in the interactions nor are there metadata")
        interactions = interactions.join(metadata.select("user_id", "device_type"), "user_id", "left")
    per = interactions.groupBy("device_type").agg(
        F.avg("duration_ms").alias("avg_duration_ms"), F.count(F.lit(1)).alias("total_interactions"), F.count_distinct("user_id").alias("unique_users"),
        F.count("duration_ms").alias("_n"), F.var_samp("duration_ms").alias("_v"),
    )
    per = with_percentiles(per, interactions, "duration_ms", ["device_type"], (0.95,)).withColumn("p95_duration_ms", F.col("_p")[0])
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("_mean", F.try_divide(F.sum(F.col("_n") * F.col("avg_duration_ms")).over(every), F.sum("_n").over(every)))
    per = per.withColumns(
        {
            "_ssb": F.sum(F.col("_n") * F.pow(F.col("avg_duration_ms") - F.col("_mean"), 2)).over(every),
            "_ssw": F.sum(F.when(F.col("_n") > 1, (F.col("_n") - 1) * F.col("_v")).otherwise(0.0)).over(every),
            "_groups": F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).over(every),
            "_all": F.sum("_n").over(every),
        }
    )
    usable = (F.col("_groups") > 1) & (F.col("_groups") < F.col("_all")) & (F.col("_ssw") > 0)
    f = F.try_divide(F.col("_ssb") / F.when(F.col("_groups") > 1, F.col("_groups") - 1), F.try_divide(F.col("_ssw"), (F.col("_all") - F.col("_groups")).cast("double")))
    return per.select(
        "device_type", "avg_duration_ms", "p95_duration_ms", "total_interactions", "unique_users",
        F.try_divide(F.col("total_interactions").cast("double"), "unique_users").alias("interactions_per_user"),
        F.when(usable, f).alias("f_statistic"), F.try_divide("_ssb", F.col("_ssb") + F.col("_ssw")).alias("eta_squared"),
    ).orderBy(F.desc("avg_duration_ms"))


def _z(value: str, mean: Column, deviation: Column) -> Column:
    return F.when(deviation.isNull() | (deviation == 0), F.lit(0.0)).otherwise((F.col(value) - mean) / deviation)


def anomalies(df: DataFrame, value: str, z: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Rows beyond ``z`` deviations of a baseline that is taken without the rows that are so at first.

    Statistics are aggregated in part before any shuffle and joined back by group; a group with most of the rows is
    no single task. Null group keys have no baseline. Adds baseline_mean, baseline_stddev, z_score, anomaly_type.
    """
    by = by or []
    need(df, value, *by)

    def attach(rows: DataFrame, stats: DataFrame) -> DataFrame:
        return rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # without keys one row

    def stats(rows: DataFrame, m: str, s: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.avg(value).alias(m), F.stddev_samp(value).alias(s))

    first = attach(df, stats(df, "_m", "_s"))
    calm = first.filter(F.abs(_z(value, F.col("_m"), F.col("_s"))) <= z)
    rows = attach(df, stats(calm, "baseline_mean", "baseline_stddev"))
    rows = rows.withColumn("z_score", _z(value, F.col("baseline_mean"), F.col("baseline_stddev"))).filter(F.abs("z_score") > z)
    kind = F.when(F.col(value) > F.col("baseline_mean"), "high").otherwise("low")
    return rows.withColumn("anomaly_type", kind).select(*df.columns, "baseline_mean", "baseline_stddev", "z_score", "anomaly_type")


def severity(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= Z_CRITICAL, "critical").when(size >= Z_HIGH, "high").when(size >= Z_MEDIUM, "medium").otherwise("low")


def anomaly_report(daily: DataFrame, metric: str, z: float = 3.0, by: list[str] | None = None, detected_at=None) -> DataFrame:
    """Anomalies as alert rows, with severity and a description."""
    found = anomalies(daily, metric, z, by)
    when = F.current_timestamp() if detected_at is None else F.lit(detected_at).cast("timestamp")
    device = F.col("device_type") if "device_type" in daily.columns else F.lit(None).cast("string")
    text = F.concat(F.lit(f"{metric} "), F.round(metric, 2).cast("string"), F.lit(" against "), F.round("baseline_mean", 2).cast("string"), F.lit(", z "), F.round("z_score", 2).cast("string"))
    return found.select(
        "app_version", device.alias("device_type"), "metric_date", F.lit(metric).alias("metric_name"), F.col(metric).cast("double").alias("metric_value"),
        F.col("baseline_mean").alias("expected_value"), "z_score", severity(F.col("z_score")).alias("severity"), when.alias("detected_at"), text.alias("description"),
    )
