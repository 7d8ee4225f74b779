"""The registered queries over the driver's tables, each with SQL of the same meaning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import monitoring, schema
from pulsegrid.operators import checks, engagement, joins, performance, retention, sessions
from pulsegrid.plans import jobs, ml, serving
from pulsegrid.sources import adapters, files, generator, jdbc
from pulsegrid.streaming import metrics

AS_OF, RUN_DATE, SIX_HOURS = "2024-01-30", "2024-01-31", 21_600

# Common table expressions by name; each may use those before it.
CTES = {
    "i": """SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS timestamp, event_type AS action_type, 'p' || json_extract_string(props, '$.k') AS page_id,
      CAST(round(value * 1000) AS INT) AS duration_ms, '3.' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) || '.0' AS app_version FROM events""",
    "u": """SELECT CAST(c_custkey AS VARCHAR) AS user_id, (['iPhone', 'iPad', 'Android Phone', 'Android Tablet'])[CAST(c_custkey % 4 AS INT) + 1] AS device_type,
      n_name AS country, c_mktsegment AS subscription_type, CAST(DATE '2023-12-04' + CAST(c_custkey % 42 AS INT) AS DATE) AS registration_date
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "oi": "SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS timestamp, CAST(round(o_totalprice) AS INT) AS duration_ms FROM orders",
    "ou": "SELECT user_id, min(CAST(timestamp AS DATE)) AS registration_date FROM oi GROUP BY 1",
    "dau": """SELECT CAST(timestamp AS DATE) AS date, count(DISTINCT user_id) AS daily_active_users, count(*) AS total_interactions, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms,
      CAST(sum(duration_ms) AS DOUBLE) / count(DISTINCT user_id) AS avg_duration_per_user FROM i GROUP BY 1""",
    "odau": """SELECT CAST(timestamp AS DATE) AS date, count(DISTINCT user_id) AS daily_active_users, count(*) AS total_interactions, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM oi GROUP BY 1""",
    "mau": "SELECT CAST(date_trunc('month', timestamp) AS DATE) AS month, count(DISTINCT user_id) AS monthly_active_users, count(*) AS total_interactions FROM oi GROUP BY 1",
    "sticky": """SELECT m.month, avg(d.daily_active_users) AS avg_dau, m.monthly_active_users, avg(d.daily_active_users) / m.monthly_active_users AS stickiness_ratio
      FROM odau d JOIN mau m ON date_trunc('month', d.date) = m.month GROUP BY m.month, m.monthly_active_users""",
    "daily": """SELECT d.date, d.daily_active_users AS dau, m.monthly_active_users AS mau, CAST(d.daily_active_users AS DOUBLE) / m.monthly_active_users AS stickiness
      FROM odau d JOIN mau m ON date_trunc('month', d.date) = m.month""",
    "totals": """SELECT user_id, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, count(*) AS total_interactions, count(DISTINCT CAST(timestamp AS DATE)) AS days_active,
      count(DISTINCT page_id) AS unique_pages, sum(duration_ms) / 3600000.0::DOUBLE AS hours_spent, CAST(sum(duration_ms) AS DOUBLE) / count(*) AS avg_duration_ms
      FROM i WHERE duration_ms <= 28800000 GROUP BY 1""",
    "power": """SELECT t.user_id, total_duration_ms, total_interactions, days_active, unique_pages, hours_spent, avg_duration_ms AS avg_duration_per_interaction, avg_duration_ms,
      CASE WHEN k <= 1 THEN 100.0::DOUBLE ELSE 95.0::DOUBLE + CAST(k - rn AS DOUBLE) / (k - 1) * 5.000000000000004::DOUBLE END AS percentile_rank, device_type, country, subscription_type, registration_date
      FROM (SELECT *, row_number() OVER (ORDER BY total_duration_ms DESC, user_id) AS rn, greatest(1, count(*) OVER () - CAST(ceil(0.95 * (count(*) OVER () - 1)) AS BIGINT)) AS k FROM totals) t
      LEFT JOIN u ON t.user_id = u.user_id WHERE rn <= k""",
    "cw": "SELECT user_id, CAST(date_trunc('week', registration_date) AS DATE) AS cohort_week FROM u",
    "coh": """SELECT s.cohort_week, g.w::INT AS week_number, s.cohort_size, coalesce(r.n, 0) AS retained_users, CAST(coalesce(r.n, 0) AS DOUBLE) / s.cohort_size AS retention_rate
      FROM (SELECT cohort_week, count(DISTINCT user_id) AS cohort_size FROM cw GROUP BY 1) s CROSS JOIN range(26) g(w)
      LEFT JOIN (SELECT cohort_week, date_diff('day', cohort_week, CAST(date_trunc('week', timestamp) AS DATE)) // 7 AS w, count(DISTINCT i.user_id) AS n
        FROM i JOIN cw ON i.user_id = cw.user_id WHERE date_trunc('week', timestamp) >= cohort_week GROUP BY 1, 2) r ON r.cohort_week = s.cohort_week AND r.w = g.w""",
    "seg": """SELECT user_id, CAST(date_trunc('week', registration_date) AS DATE) AS cohort_week, segment_type, segment_value FROM
      (SELECT user_id, registration_date, unnest(['subscription_type', 'device_type', 'country']) AS segment_type, unnest([subscription_type, device_type, country]) AS segment_value FROM u)""",
    "cohseg": """SELECT s.cohort_week, g.w::INT AS week_number, s.cohort_size, coalesce(r.n, 0) AS retained_users, CAST(coalesce(r.n, 0) AS DOUBLE) / s.cohort_size AS retention_rate, s.segment_type, s.segment_value
      FROM (SELECT cohort_week, segment_type, segment_value, count(DISTINCT user_id) AS cohort_size FROM seg GROUP BY ALL) s CROSS JOIN range(26) g(w)
      LEFT JOIN (SELECT cohort_week, segment_type, segment_value, date_diff('day', cohort_week, CAST(date_trunc('week', timestamp) AS DATE)) // 7 AS w, count(DISTINCT i.user_id) AS n
        FROM i JOIN seg ON i.user_id = seg.user_id WHERE date_trunc('week', timestamp) >= cohort_week GROUP BY ALL) r
      ON r.cohort_week = s.cohort_week AND r.segment_type = s.segment_type AND r.segment_value = s.segment_value AND r.w = g.w""",
    "curve": "SELECT week_number, round(avg(retention_rate) * 100, 1) AS avg_retention_pct FROM coh GROUP BY 1",
    "perf": """SELECT app_version, CAST(timestamp AS DATE) AS metric_date, count(*) AS count, avg(duration_ms) AS avg_duration_ms, stddev_samp(duration_ms) AS stddev_duration_ms,
      quantile_disc(duration_ms, 0.5) AS p50_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms, quantile_disc(duration_ms, 0.99) AS p99_duration_ms FROM i GROUP BY 1, 2""",
    "devp": """SELECT device_type, CAST(timestamp AS DATE) AS metric_date, count(*) AS count, avg(duration_ms) AS avg_duration_ms, stddev_samp(duration_ms) AS stddev_duration_ms,
      quantile_disc(duration_ms, 0.5) AS p50_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms, quantile_disc(duration_ms, 0.99) AS p99_duration_ms, count(DISTINCT i.user_id) AS user_count
      FROM i LEFT JOIN u ON i.user_id = u.user_id GROUP BY 1, 2""",
    "dev": """SELECT device_type, avg(duration_ms) AS avg_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms, count(*) AS total_interactions, count(DISTINCT i.user_id) AS unique_users,
      CAST(count(*) AS DOUBLE) / count(DISTINCT i.user_id) AS interactions_per_user, count(duration_ms) AS n, var_samp(duration_ms) AS v FROM i LEFT JOIN u ON i.user_id = u.user_id GROUP BY 1""",
    "corr": """SELECT device_type, avg_duration_ms, p95_duration_ms, total_interactions, unique_users, interactions_per_user, (ssb / (k - 1)) / (ssw / (total - k)) AS f_statistic, ssb / (ssb + ssw) AS eta_squared
      FROM dev, (SELECT sum(n * (avg_duration_ms - m) ** 2) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, sum(n) AS total FROM dev, (SELECT sum(n * avg_duration_ms) / sum(n) AS m FROM dev))""",
    "z1": """SELECT e.*, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events e""",
    "anom": """SELECT event_id, event_type, value, baseline_mean, baseline_stddev, (value - baseline_mean) / baseline_stddev AS z_score, CASE WHEN value > baseline_mean THEN 'high' ELSE 'low' END AS anomaly_type
      FROM z1 JOIN (SELECT event_type, avg(value) AS baseline_mean, stddev_samp(value) AS baseline_stddev FROM z1 WHERE abs((value - m) / s) <= 3 GROUP BY 1) b USING (event_type)
      WHERE abs((value - baseline_mean) / baseline_stddev) > 3""",
    "full": "SELECT i.*, device_type, country, subscription_type, registration_date FROM i LEFT JOIN u ON i.user_id = u.user_id",
    "gaps": """SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) + INTERVAL '{gap} seconds' THEN 0 ELSE 1 END AS starts FROM full_""",
    "runs": "SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM gaps",
    "s": """SELECT user_id || '_' || strftime(min(timestamp), '%Y%m%d%H%M%S') AS session_id, user_id, min(timestamp) AS session_start_time, max(timestamp) + INTERVAL '{gap} seconds' AS session_end_time, max(timestamp) AS last_event_time,
      count(*) AS action_count, CAST(sum(duration_ms) AS BIGINT) AS total_action_duration_ms, avg(duration_ms) AS avg_action_duration_ms, arg_max(duration_ms, timestamp) AS last_action_duration_ms,
      CASE WHEN count(*) = 1 THEN CAST(max(duration_ms) AS BIGINT) ELSE CAST((epoch(date_trunc('second', max(timestamp))) - epoch(date_trunc('second', min(timestamp)))) * 1000 AS BIGINT) + arg_max(duration_ms, timestamp) END AS session_duration_ms,
      count(*) = 1 AS is_bounce, arg_min(device_type, timestamp) AS device_type, arg_min(country, timestamp) AS country FROM runs GROUP BY user_id, run""",
    "freq": """SELECT user_id, count(*) AS total_sessions, count(DISTINCT CAST(session_start_time AS DATE)) AS active_days, min(CAST(session_start_time AS DATE)) AS first_session_date, max(CAST(session_start_time AS DATE)) AS last_session_date,
      arg_min(device_type, session_start_time) AS device_type, arg_min(country, session_start_time) AS country, CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(session_start_time AS DATE)) AS avg_sessions_per_day FROM s GROUP BY 1""",
    "bounce": f"""SELECT *, bounced_sessions * 100.0::DOUBLE / total_sessions AS bounce_rate FROM (
      SELECT DATE '{RUN_DATE}' AS metric_date, NULL::VARCHAR AS dimension_name, NULL::VARCHAR AS dimension_value, count(*) AS total_sessions, CAST(sum(is_bounce::INT) AS BIGINT) AS bounced_sessions FROM s
      UNION ALL SELECT CAST(session_start_time AS DATE), 'device_type', device_type, count(*), CAST(sum(is_bounce::INT) AS BIGINT) FROM s GROUP BY 1, 3
      UNION ALL SELECT CAST(session_start_time AS DATE), 'country', country, count(*), CAST(sum(is_bounce::INT) AS BIGINT) FROM s GROUP BY 1, 3)""",
}
_USES = {
    "ou": "oi", "dau": "i", "odau": "oi", "mau": "oi", "sticky": "odau mau", "daily": "odau mau", "totals": "i", "power": "totals u", "cw": "u", "coh": "cw i", "seg": "u", "cohseg": "seg i", "curve": "coh",
    "perf": "i", "devp": "i u", "dev": "i u", "corr": "dev", "anom": "z1", "full": "i u", "gaps": "full", "runs": "gaps", "s": "runs", "freq": "s", "bounce": "s",
}


def sql(body: str, *ctes: str, gap: int = SIX_HOURS) -> str:
    found: list[str] = []

    def add(name: str) -> None:
        for x in _USES.get(name, "").split():
            add(x)
        if name not in found:
            found.append(name)

    for name in ctes:
        add(name)
    fixed = {k: v.replace("{gap}", str(gap)).replace("full_", '"full"') for k, v in CTES.items()}
    head = ",\n".join(f'"{k}" AS ({fixed[k]})' for k in found)
    return (f"WITH {head}\n" if head else "") + body


class Tables:
    """The model's tables over a folder, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.i, self.u = adapters.interactions(spark, sf_dir), adapters.users(spark, sf_dir)
        self.oi = adapters.order_interactions(spark, sf_dir)
        self.events = adapters.table(spark, sf_dir, "events")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    dau = property(lambda t: engagement.daily_active(t.i))
    odau = property(lambda t: engagement.daily_active(t.oi))
    mau = property(lambda t: engagement.monthly_active(t.oi))
    daily = property(lambda t: engagement.stickiness_daily(t.odau, t.mau))
    sticky = property(lambda t: engagement.stickiness(t.odau, t.mau))
    power = property(lambda t: engagement.power_users(t.i, t.u, 0.95))
    coh = property(lambda t: retention.cohort_retention(t.i, t.u))
    cohseg = property(lambda t: retention.cohort_retention_by_segment(t.i, t.u))
    full = property(lambda t: t.i.join(t.u, "user_id", "left"))
    perf = property(lambda t: performance.named_percentiles(t.i.withColumn("metric_date", F.to_date("timestamp")), "duration_ms", ["app_version", "metric_date"]))
    devp = property(lambda t: performance.device_performance(t.full))
    corr = property(lambda t: performance.device_correlation(t.i, t.u))
    anom = property(lambda t: performance.anomalies(t.events.select("event_id", "event_type", "value"), "value", 3.0, ["event_type"]))
    report = property(lambda t: performance.anomaly_report(t.perf, "avg_duration_ms", 2.0, detected_at=f"{AS_OF} 12:00:00"))

    def sessions(self, gap: int = SIX_HOURS) -> DataFrame:
        return sessions.session_metrics(self.full, gap)

    s = property(lambda t: t.sessions())
    freq = property(lambda t: sessions.session_frequency(t.s, ("device_type", "country")))
    bounce = property(lambda t: sessions.bounce_rates(t.s, RUN_DATE))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


SESSION_COLS = ["session_id", "user_id", "session_start_time", "session_end_time", "last_event_time", "action_count", "total_action_duration_ms", "avg_action_duration_ms", "last_action_duration_ms", "session_duration_ms", "is_bounce", "device_type", "country"]
_S = ", ".join(SESSION_COLS)
_PERF = "count, avg_duration_ms, round(stddev_duration_ms, 4) AS stddev_duration_ms, p50_duration_ms, p95_duration_ms, p99_duration_ms"
_REPORT = """report AS (SELECT app_version, metric_date, avg_duration_ms AS v, m2, s2, (avg_duration_ms - m2) / s2 AS z FROM perf, (SELECT avg(avg_duration_ms) AS m2, stddev_samp(avg_duration_ms) AS s2
  FROM perf, (SELECT avg(avg_duration_ms) AS m1, stddev_samp(avg_duration_ms) AS s1 FROM perf) WHERE abs((avg_duration_ms - m1) / s1) <= 2) WHERE abs((avg_duration_ms - m2) / s2) > 2)"""

# name: (frame, SQL or None)
QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "dau": (lambda t: t.dau, sql("SELECT * FROM dau", "dau")),
    "mau": (lambda t: t.mau, sql("SELECT * FROM mau", "mau")),
    "rolling_active_30": (lambda t: engagement.rolling_active(t.i), sql("SELECT d.date, count(DISTINCT i.user_id) AS active_users FROM dau d JOIN i ON CAST(i.timestamp AS DATE) BETWEEN d.date - 29 AND d.date GROUP BY 1", "dau")),
    "stickiness": (lambda t: _rounded(t.sticky, avg_dau=9, stickiness_ratio=9), sql("SELECT month, round(avg_dau, 9) AS avg_dau, monthly_active_users, round(stickiness_ratio, 9) AS stickiness_ratio FROM sticky", "sticky")),
    "stickiness_daily": (lambda t: t.daily, sql("SELECT * FROM daily", "daily")),
    "stickiness_recent": (lambda t: serving.stickiness_recent(t.daily, "2001-07-01"), sql("SELECT round(avg(stickiness), 6) AS avg_stickiness FROM daily WHERE date >= DATE '2001-07-01' - 7", "daily")),
    "stickiness_trend": (lambda t: serving.stickiness_trend(t.daily, "2001-07-01"), sql("SELECT date, stickiness, dau, mau FROM daily WHERE date >= DATE '2001-07-01' - 90", "daily")),
    "power_users": (lambda t: _rounded(t.power, percentile_rank=6), sql("SELECT * REPLACE (round(percentile_rank, 6) AS percentile_rank) FROM power", "power")),
    "power_users_by_country": (lambda t: serving.count_by(t.power, "country"), sql("SELECT country, count(*) AS user_count FROM power GROUP BY 1", "power")),
    "power_users_top_countries": (lambda t: serving.count_by(t.power, "country", 10), sql("SELECT country, count(*) AS user_count FROM power GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "power")),
    "power_users_by_device": (lambda t: serving.count_by(t.power, "device_type"), sql("SELECT device_type, count(*) AS user_count FROM power GROUP BY 1", "power")),
    "power_users_top100": (lambda t: serving.power_user_table(t.power), sql("SELECT user_id, total_interactions, hours_spent AS total_duration_hours, round(avg_duration_ms / 1000, 2) AS avg_seconds, country, device_type, subscription_type, registration_date FROM power ORDER BY hours_spent DESC, user_id LIMIT 100", "power")),
    "engagement_histogram": (lambda t: serving.engagement_hours(t.power), sql("SELECT hours_spent AS total_duration_hours FROM power", "power")),
    "hours_by_subscription": (lambda t: serving.hours_by_subscription(t.power), sql("SELECT subscription_type, round(avg(hours_spent), 9) AS avg_hours, count(*) AS user_count FROM power GROUP BY 1", "power")),
    "dau_series": (lambda t: serving.dau_series(t.dau, AS_OF, 14), sql(f"SELECT date, daily_active_users AS dau, total_interactions FROM dau WHERE date >= DATE '{AS_OF}' - 14", "dau")),
    "dau_rolling": (lambda t: serving.dau_rolling(t.dau), sql("SELECT date, daily_active_users, round(avg(daily_active_users) OVER (ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM dau", "dau")),
    "mau_recent": (lambda t: serving.mau_recent(t.mau), sql("SELECT strftime(month, '%Y-%m') AS year_month, monthly_active_users AS mau, total_interactions FROM mau ORDER BY 1 DESC LIMIT 12", "mau")),
    "engagement_summary": (lambda t: serving.engagement_summary(t.dau, AS_OF), sql(f"SELECT avg(daily_active_users) AS avg_daily_active_users, avg(total_interactions) AS avg_daily_interactions, sum(total_duration_ms) / 1000 / 60 AS total_minutes FROM dau WHERE date >= DATE '{AS_OF}' - 30", "dau")),
    "chart_kpis": (lambda t: serving.chart_kpis(t.odau, t.mau, t.sticky), sql("SELECT round(a.x / 60000, 6) AS engaged_minutes_per_user, a.y AS interactions_per_user, a.z AS avg_dau, b.avg_mau, c.max_stickiness FROM (SELECT avg(CAST(total_duration_ms AS DOUBLE) / daily_active_users) AS x, CAST(sum(total_interactions) AS DOUBLE) / sum(daily_active_users) AS y, avg(daily_active_users) AS z FROM odau) a, (SELECT avg(monthly_active_users) AS avg_mau FROM mau) b, (SELECT round(max(stickiness_ratio), 9) AS max_stickiness FROM sticky) c", "sticky")),
    "cohort_retention": (lambda t: t.coh, sql("SELECT * FROM coh", "coh")),
    "cohort_retention_orders": (lambda t: retention.cohort_retention(t.oi, adapters.order_users(t.spark, t.sf_dir), periods=52), sql("""SELECT s.cohort_week, g.w::INT AS week_number, s.cohort_size, coalesce(r.n, 0) AS retained_users, CAST(coalesce(r.n, 0) AS DOUBLE) / s.cohort_size AS retention_rate
      FROM (SELECT cohort_week, count(DISTINCT user_id) AS cohort_size FROM c GROUP BY 1) s CROSS JOIN range(52) g(w) LEFT JOIN (SELECT cohort_week, date_diff('day', cohort_week, CAST(date_trunc('week', timestamp) AS DATE)) // 7 AS w, count(DISTINCT oi.user_id) AS n
      FROM oi JOIN c ON oi.user_id = c.user_id GROUP BY 1, 2) r ON r.cohort_week = s.cohort_week AND r.w = g.w""", "ou").replace("\nSELECT s.cohort", ",\nc AS (SELECT user_id, CAST(date_trunc('week', registration_date) AS DATE) AS cohort_week FROM ou)\nSELECT s.cohort", 1)),
    "cohort_retention_by_segment": (lambda t: t.cohseg, sql("SELECT * FROM cohseg", "cohseg")),
    "cohort_heatmap": (lambda t: serving.cohort_heatmap(t.coh), sql("SELECT cohort_week, week_number, retention_rate, cohort_size, retained_users FROM coh WHERE week_number <= 26", "coh")),
    "retention_heatmap_pct": (lambda t: serving.retention_heatmap(t.coh), sql("SELECT CAST(cohort_week AS VARCHAR) AS cohort_week, week_number, round(retention_rate * 100, 1) AS retention_pct FROM coh", "coh")),
    "latest_cohorts_curves": (lambda t: serving.latest_curves(t.coh, 10), sql("SELECT cohort_week, week_number, retention_rate FROM coh WHERE week_number <= 12 AND cohort_week IN (SELECT DISTINCT cohort_week FROM coh ORDER BY 1 DESC LIMIT 10)", "coh")),
    "retention_w0_w12": (lambda t: serving.retention_at(t.coh), sql("SELECT week_number, round(avg(retention_rate), 9) AS avg_retention FROM coh WHERE week_number IN (0, 12) GROUP BY 1", "coh")),
    "retention_curve_avg": (lambda t: retention.average_curve(t.coh), sql("SELECT * FROM curve", "curve")),
    "retention_curve_mature": (lambda t: retention.mature_curve(t.coh, AS_OF), sql(f"SELECT week_number, round(avg(retention_rate) * 100, 1) AS avg_retention_pct FROM coh WHERE cohort_week + week_number * 7 <= DATE '{AS_OF}' GROUP BY 1", "coh")),
    "retention_wow_drop": (lambda t: retention.weekly_drop(retention.average_curve(t.coh)), sql("SELECT *, round(lag(avg_retention_pct) OVER (ORDER BY week_number) - avg_retention_pct, 1) AS drop_pct FROM curve", "curve")),
    "retention_by_segment_curve": (lambda t: retention.average_curve(t.cohseg, "segment_type", "segment_value"), sql("SELECT week_number, segment_type, segment_value, round(avg(retention_rate) * 100, 1) AS avg_retention_pct FROM cohseg GROUP BY ALL", "cohseg")),
    "retention_quarter": (lambda t: serving.retention_quarter(t.coh), sql("SELECT 'Q' || quarter(cohort_week) || ' ' || year(cohort_week) AS registration_quarter, week_number, round(avg(retention_rate) * 100, 1) AS avg_retention_pct FROM coh WHERE week_number IN (1, 4, 8) GROUP BY ALL", "coh")),
    "retention_kpi": (lambda t: serving.retention_kpi(t.coh), sql("SELECT round(avg(retention_rate * 100) FILTER (week_number = 0), 1) AS w0_pct, round(avg(retention_rate * 100) FILTER (week_number = 1), 1) AS w1_pct, round(avg(retention_rate * 100) FILTER (week_number >= 7), 1) AS plateau_pct FROM coh", "coh")),
    "retention_pivot": (lambda t: ml.retention_pivot(t.coh), sql("SELECT cohort_week, any_value(cohort_size) AS cohort_size, " + ", ".join(f"max(retention_rate) FILTER (week_number = {w}) AS week_{w}" for w in range(13)) + " FROM coh GROUP BY 1", "coh")),
    "activation_gap": (lambda t: retention.activation_gap(t.i, t.u), sql("SELECT count(*) AS users, count(*) FILTER (gap <= 7) AS within_7, count(*) FILTER (gap <= 30) AS within_30, count(*) FILTER (gap <= 90) AS within_90, quantile_disc(gap, 0.5)::INT AS median_gap, quantile_disc(gap, 0.75)::INT AS p75_gap, quantile_disc(gap, 0.9)::INT AS p90_gap FROM (SELECT date_diff('day', registration_date, f) AS gap FROM u JOIN (SELECT user_id, min(CAST(timestamp AS DATE)) AS f FROM i GROUP BY 1) x ON x.user_id = u.user_id) WHERE gap >= 0", "i", "u")),
    "percentiles_by_version": (lambda t: _rounded(t.perf, stddev_duration_ms=4), sql(f"SELECT app_version, metric_date, {_PERF} FROM perf", "perf")),
    "device_performance": (lambda t: _rounded(t.devp, stddev_duration_ms=4), sql(f"SELECT device_type, metric_date, {_PERF}, user_count FROM devp", "devp")),
    "device_share": (lambda t: serving.device_share(t.devp), sql("SELECT device_type, sum(user_count)::BIGINT AS user_count, round(sum(user_count) * 100.0 / sum(sum(user_count)) OVER (), 2) AS contribution_pct FROM devp GROUP BY 1", "devp")),
    "device_comparison": (lambda t: serving.device_comparison(t.devp, AS_OF), sql(f"SELECT device_type, round(avg(avg_duration_ms), 4) AS avg_load_time, round(avg(p95_duration_ms), 4) AS p95_load_time, sum(count)::BIGINT AS total_interactions FROM devp WHERE metric_date >= DATE '{AS_OF}' - 7 GROUP BY 1", "devp")),
    "device_correlation": (lambda t: _rounded(t.corr, f_statistic=6, eta_squared=9), sql("SELECT * REPLACE (round(f_statistic, 6) AS f_statistic, round(eta_squared, 9) AS eta_squared) FROM corr", "corr")),
    "device_table": (lambda t: serving.device_table(t.corr), sql("SELECT device_type, round(avg_duration_ms, 2) AS avg_duration_ms, round(p95_duration_ms, 2) AS p95_duration_ms, total_interactions, unique_users, round(interactions_per_user, 2) AS interactions_per_user FROM corr", "corr")),
    "device_table_anova": (lambda t: serving.device_table(t.corr, True), sql("SELECT device_type, round(avg_duration_ms, 2) AS avg_duration_ms, round(p95_duration_ms, 2) AS p95_duration_ms, total_interactions, unique_users, round(interactions_per_user, 2) AS interactions_per_user, round(f_statistic, 4) AS f_statistic, round(eta_squared, 4) AS eta_squared FROM corr", "corr")),
    "version_series": (lambda t: serving.version_series(t.perf, AS_OF), sql(f"SELECT metric_date, app_version, p50_duration_ms, p95_duration_ms, p99_duration_ms, count AS total_interactions FROM perf WHERE metric_date >= DATE '{AS_OF}' - 30", "perf")),
    "latency_gap": (lambda t: serving.latency_gap(t.perf, AS_OF), sql(f"SELECT metric_date, app_version, p99_duration_ms - p50_duration_ms AS latency_gap FROM perf WHERE metric_date >= DATE '{AS_OF}' - 30", "perf")),
    "version_heatmap": (lambda t: serving.version_heatmap(t.perf, AS_OF), sql(f"SELECT metric_date, app_version, p95_duration_ms FROM perf WHERE metric_date >= DATE '{AS_OF}' - 14", "perf")),
    "anomalies_by_group": (lambda t: _rounded(t.anom, baseline_mean=6, baseline_stddev=6, z_score=6), sql("SELECT * REPLACE (round(baseline_mean, 6) AS baseline_mean, round(baseline_stddev, 6) AS baseline_stddev, round(z_score, 6) AS z_score) FROM anom", "anom")),
    "anomalies_global": (lambda t: _rounded(performance.anomalies(t.events.select("event_id", "value"), "value"), baseline_mean=6, baseline_stddev=6, z_score=6), "SELECT event_id, value, round(m2, 6) AS baseline_mean, round(s2, 6) AS baseline_stddev, round((value - m2) / s2, 6) AS z_score, CASE WHEN value > m2 THEN 'high' ELSE 'low' END AS anomaly_type FROM events, (SELECT avg(value) AS m2, stddev_samp(value) AS s2 FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) <= 3) WHERE abs((value - m2) / s2) > 3"),
    "anomaly_severity": (lambda t: t.anom.groupBy("event_type", performance.severity(F.col("z_score")).alias("severity")).agg(F.count(F.lit(1)).alias("n")), sql("SELECT event_type, CASE WHEN abs(z_score) >= 4 THEN 'critical' WHEN abs(z_score) >= 3.5 THEN 'high' WHEN abs(z_score) >= 3 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM anom GROUP BY ALL", "anom")),
    "anomaly_alerts": (lambda t: serving.alerts(t.report, AS_OF), sql(f"SELECT '{AS_OF} 12:00' AS detected_time, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3.5 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity, app_version, NULL::VARCHAR AS device_type, 'avg_duration_ms ' || round(v, 2) || ' against ' || round(m2, 2) || ', z ' || round(z, 2) AS description, 'avg_duration_ms' AS metric_name, round(v, 2) AS value, round(z, 2) AS z_score FROM report ORDER BY 2 DESC, app_version, metric_date LIMIT 50", "perf").replace("\nSELECT '", f",\n{_REPORT}\nSELECT '", 1)),
    "critical_anomalies": (lambda t: serving.critical_count(t.report, AS_OF), sql("SELECT count(*) FILTER (abs(z) >= 4) AS critical_anomalies FROM report", "perf").replace("\nSELECT count(*) FILTER", f",\n{_REPORT}\nSELECT count(*) FILTER", 1)),
    "session_metrics_1800": (lambda t: t.sessions(1800).select(*SESSION_COLS), sql(f"SELECT {_S} FROM s", "s", gap=1800)),
    "session_metrics_600": (lambda t: t.sessions(600).select(*SESSION_COLS), sql(f"SELECT {_S} FROM s", "s", gap=600)),
    "session_metrics_6h": (lambda t: t.s.select(*SESSION_COLS), sql(f"SELECT {_S} FROM s", "s")),
    "session_frequency": (lambda t: t.freq, sql("SELECT * FROM freq", "freq")),
    "bounce_overall": (lambda t: sessions.bounce_rate(t.s), sql("SELECT count(*) AS total_sessions, CAST(sum(is_bounce::INT) AS BIGINT) AS bounced_sessions, sum(is_bounce::INT) * 100.0::DOUBLE / count(*) AS bounce_rate FROM s", "s")),
    "bounce_rates": (lambda t: t.bounce, sql("SELECT * FROM bounce", "bounce")),
    "bounce_by_device": (lambda t: serving.bounce_by(t.bounce, "device_type"), sql("SELECT dimension_value AS device_type, round(avg(bounce_rate), 6) AS avg_bounce_rate, sum(total_sessions)::BIGINT AS total_sessions, sum(bounced_sessions)::BIGINT AS bounced_sessions FROM bounce WHERE dimension_name = 'device_type' GROUP BY 1", "bounce")),
    "bounce_by_country": (lambda t: serving.bounce_by(t.bounce, "country"), sql("SELECT dimension_value AS country, round(avg(bounce_rate), 6) AS avg_bounce_rate, sum(total_sessions)::BIGINT AS total_sessions, sum(bounced_sessions)::BIGINT AS bounced_sessions FROM bounce WHERE dimension_name = 'country' GROUP BY 1", "bounce")),
    "bounce_trend": (lambda t: serving.bounce_trend(t.bounce, RUN_DATE), sql("SELECT metric_date, bounce_rate, total_sessions, bounced_sessions FROM bounce WHERE dimension_name IS NULL", "bounce")),
    "bounce_recent": (lambda t: serving.bounce_recent(t.bounce, RUN_DATE), sql("SELECT avg(bounce_rate) AS overall_bounce_rate FROM bounce WHERE dimension_name IS NULL", "bounce")),
    "session_duration_buckets": (lambda t: serving.duration_buckets(t.s), sql("SELECT CASE WHEN session_duration_ms < 60000 THEN '< 1 min' WHEN session_duration_ms < 300000 THEN '1-5 min' WHEN session_duration_ms < 900000 THEN '5-15 min' WHEN session_duration_ms < 1800000 THEN '15-30 min' ELSE '> 30 min' END AS duration_bucket, count(*) AS session_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM s GROUP BY 1", "s")),
    "action_buckets": (lambda t: serving.action_buckets(t.s), sql("SELECT CASE WHEN action_count = 1 THEN '1 action (Bounce)' WHEN action_count BETWEEN 2 AND 3 THEN '2-3 actions' WHEN action_count BETWEEN 4 AND 10 THEN '4-10 actions' ELSE '> 10 actions' END AS action_bucket, count(*) AS session_count FROM s GROUP BY 1", "s")),
    "duration_by_device": (lambda t: serving.duration_by_device(t.s), sql("SELECT device_type, round(avg(session_duration_ms) / 1000, 6) AS avg_duration_seconds, round(avg(action_count), 6) AS avg_actions, count(*) AS session_count FROM s GROUP BY 1", "s")),
    "session_summary": (lambda t: serving.session_summary(t.s), sql("SELECT count(*) AS total_sessions, round(avg(session_duration_ms) / 1000, 2) AS avg_duration_sec, round(avg(action_count), 2) AS avg_actions_per_session, round(sum(is_bounce::INT) * 100.0 / count(*), 2) AS bounce_rate_pct FROM s", "s")),
    "frequency_by_device_country": (lambda t: serving.frequency_by_device_country(t.freq), sql("SELECT device_type, country, count(*) AS user_count, round(avg(total_sessions), 2) AS avg_sessions_per_user, round(avg(active_days), 2) AS avg_active_days, round(avg(avg_sessions_per_day), 2) AS avg_sessions_per_day, count(*) FILTER (total_sessions > 1) AS return_users, round(count(*) FILTER (total_sessions > 1) * 100.0 / count(*), 2) AS return_rate FROM freq GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100", "freq")),
    "actions_histogram": (lambda t: serving.action_sample(t.s), sql("SELECT action_count FROM s WHERE action_count <= 50 LIMIT 10000", "s")),
    "sessions_histogram": (lambda t: serving.session_sample(t.freq), sql("SELECT total_sessions FROM freq WHERE total_sessions <= 100 LIMIT 10000", "freq")),
    "enrich_left_join": (lambda t: joins.enrich(t.i, t.u), sql('SELECT *, CAST(timestamp AS DATE) AS date FROM "full"', "full")),
    "salted_join": (lambda t: joins.salted_join(t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")), t.table("supplier"), "s_suppkey", joins.hot_keys(t.table("lineitem").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", 0.9)), "SELECT l_orderkey, l_linenumber, s_suppkey, s_name, s_nationkey, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "hot_keys": (lambda t: joins.hot_keys(t.table("lineitem"), "l_suppkey", 0.9), "WITH c AS (SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1) SELECT * FROM c WHERE count > (SELECT quantile_disc(count, 0.9) FROM c)"),
    "null_report": (lambda t: checks.detect_nulls(t.table("documents").select("doc_id", "lang").join(t.table("labels"), "doc_id", "left"), ["lang", "quality", "toxic"]).withColumn("null_columns", F.array_join("null_columns", ",")), "SELECT doc_id, lang, quality, toxic, concat_ws(',', CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS null_columns FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NULL OR quality IS NULL OR toxic IS NULL"),
    "outliers_iqr": (lambda t: checks.detect_outliers(t.events.select("event_id", "value"), "value"), "SELECT event_id, value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN 'iqr_outlier_below' ELSE 'iqr_outlier_above' END AS outlier_reason, value AS outlier_value FROM events, (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"),
    "outliers_threshold": (lambda t: checks.detect_outliers(t.i.select("user_id", "duration_ms"), "duration_ms", "threshold", min_value=100, max_value=150_000), sql("SELECT user_id, duration_ms, CASE WHEN duration_ms < 100 THEN 'below_min' ELSE 'above_max' END AS outlier_reason, CAST(duration_ms AS DOUBLE) AS outlier_value FROM i WHERE duration_ms < 100 OR duration_ms > 150000", "i")),
    "churn_features": (lambda t: _rounded(ml.churn_features(t.s, t.u, away_days=10), avg_session_ms=4, bounce_share=6), sql("SELECT user_id, device_type, country, subscription_type, n AS total_sessions, round(d, 4) AS avg_session_ms, a AS total_actions, round(b, 6) AS bounce_share, days AS active_days, date_diff('day', registration_date, last_seen) AS tenure_days, (date_diff('day', last_seen, (SELECT max(CAST(session_start_time AS DATE)) FROM s)) > 10)::INT AS churned FROM (SELECT user_id, count(*) AS n, avg(session_duration_ms) AS d, sum(action_count)::BIGINT AS a, avg(is_bounce::INT) AS b, count(DISTINCT CAST(session_start_time AS DATE)) AS days, max(CAST(session_start_time AS DATE)) AS last_seen FROM s GROUP BY 1) x JOIN u USING (user_id)", "s", "u")),
    "segment_features": (lambda t: _rounded(ml.segment_features(t.freq, t.power, t.u), avg_sessions_per_day=6, hours_spent=9), sql("SELECT f.user_id, f.total_sessions, f.active_days, round(f.avg_sessions_per_day, 6) AS avg_sessions_per_day, round(coalesce(p.hours_spent, 0), 9) AS hours_spent, coalesce(p.total_interactions, 0) AS total_interactions, u.subscription_type FROM freq f JOIN u ON f.user_id = u.user_id LEFT JOIN power p ON p.user_id = f.user_id", "freq", "power")),
    "anomaly_overlap": (lambda t: ml.overlap(t.anom.select("event_type").distinct(), performance.anomalies(t.events.select("event_type", "value"), "value").select("event_type").distinct()), sql("SELECT count(*) FILTER (a AND b) AS both_methods, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second FROM (SELECT event_type, bool_or(k = 1) AS a, bool_or(k = 2) AS b FROM (SELECT DISTINCT event_type, 1 AS k FROM anom UNION ALL SELECT DISTINCT event_type, 2 FROM events, (SELECT avg(value) AS m2, stddev_samp(value) AS s2 FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) <= 3) WHERE abs((value - m2) / s2) > 3) GROUP BY 1)", "anom")),
    "lift_ntile": (lambda t: ml.lift(t.u.join(engagement.user_totals(t.i), "user_id"), "total_interactions", F.col("days_active") > 10), sql("SELECT bucket::INT AS bucket, n AS users, round(r, 6) AS rate, round(r / (sum(n * r) OVER () / sum(n) OVER ()), 4) AS lift FROM (SELECT bucket, count(*) AS n, avg((days_active > 10)::INT) AS r FROM (SELECT *, ntile(5) OVER (ORDER BY total_interactions DESC, user_id) AS bucket FROM totals) GROUP BY 1)", "totals")),
    "kmeans_segments": (lambda t: ml.segments(ml.segment_features(t.freq, t.power, t.u)), None),
    "churn_scores": (lambda t: ml.churn(ml.churn_features(t.s, t.u)).scores, None),
    "kmeans_anomalies": (lambda t: ml.kmeans_anomalies(t.i.withColumn("metric_date", F.to_date("timestamp"))), None),
    "retention_forecast": (lambda t: ml.forecast(ml.retention_pivot(retention.cohort_retention(t.oi, adapters.order_users(t.spark, t.sf_dir)))), None),
    "partition_skew": (lambda t: monitoring.partition_sizes(t.i), None),
}


_SCORED = "totals JOIN u USING (user_id)"
_LINES = "l_orderkey, l_linenumber, s_suppkey, s_name"


def _lines(t: Tables) -> DataFrame:
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))


def _suppliers(t: Tables) -> DataFrame:
    return t.table("supplier").select("s_suppkey", "s_name")


def _scored(t: Tables) -> DataFrame:
    return engagement.user_totals(t.i).join(t.u, "user_id")


def _csv(t: Tables) -> DataFrame:
    """Users written as CSV and read back by their schema."""
    path = adapters.scratch(t.spark, "csv")
    generator.write_csv({"users": t.u}, path)
    return files.read_csv(t.spark, f"{path}/users", schema.USERS)


def _by_date(t: Tables) -> DataFrame:
    """Enriched interactions written by day, overwritten, and one day read back from its folder."""
    path = adapters.scratch(t.spark, "parquet")
    for _ in range(2):
        files.write_tables({"enriched_interactions": joins.enrich(t.i, t.u)}, path, {"enriched_interactions": ["date"]})
    return files.read_parquet(t.spark, f"{path}/enriched_interactions").filter(F.col("date") == F.lit("2024-01-05").cast("date"))


def _database(t: Tables) -> jdbc.Place:
    """A database inside the driver's process; executors elsewhere read a copy in the shared folder, since only one process can have the database open."""
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = t.table("customer").select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").cast("double").alias("BALANCE"), F.col("c_nationkey").cast("int").alias("NATION"))
    if adapters.one_machine(t.spark):
        at = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", driver
        jdbc.write_table(keys, "accounts", "overwrite", at=at)
        jdbc.write_table(keys.filter("NATION = 3"), "accounts", "append", at=at)
        return at
    shared = urlparse(adapters.scratch(t.spark, "jdbc"))
    if shared.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a path on every machine for the database to be read there")
    with tempfile.TemporaryDirectory(prefix="pulsegrid-") as own:
        at = f"jdbc:derby:{own}/bank;create=true", driver
        jdbc.write_here(keys, "accounts", "overwrite", at=at)
        jdbc.write_here(keys.filter("NATION = 3"), "accounts", "append", at=at)
        return jdbc.archived(t.spark, f"{own}/bank", f"{shared.path}/bank.jar"), driver


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("ID").alias("id"), F.col("BALANCE").alias("balance"), F.col("NATION").alias("nation"))


def _validated(t: Tables) -> DataFrame:
    rows = t.table("documents").select("doc_id", "lang").join(t.table("labels"), "doc_id", "left")
    return t.spark.createDataFrame([(w,) for w in checks.validate(rows, ["doc_id"], ["doc_id", "quality", "toxic"])], "warning string")


def _schema_errors(t: Tables) -> DataFrame:
    found = checks.validate_schema(t.i.withColumns({"duration_ms": F.col("duration_ms").cast("long"), "timestamp": F.col("timestamp").cast("timestamp")}).withColumn("more", F.lit(1)).drop("page_id"), schema.INTERACTIONS)[1]
    return t.spark.createDataFrame([(e,) for e in found], "error string")


def _observed(t: Tables) -> DataFrame:
    df, seen = monitoring.observed(t.full, ["user_id", "country"], ["duration_ms"])
    df.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "null_user_id", "null_country", "negative_duration_ms"))], "rows long, null_user_id long, null_country long, negative_duration_ms long")


def _accumulated(t: Tables) -> DataFrame:
    """Rows and row errors counted by accumulators on the executors."""
    ctx = monitoring.context(t.spark.sparkContext, "quality")

    def count(rows):
        for r in monitoring.track_partition(rows, ctx):
            (ctx.records if monitoring.track_errors(r.asDict(), ctx, ["quality"], ["toxic"]) else ctx.skipped).add(1)

    t.table("documents").select("doc_id").join(t.table("labels"), "doc_id", "left").foreachPartition(count)
    return t.spark.createDataFrame([(ctx.records.value, ctx.skipped.value, ctx.errors.value.get("null_quality", 0))], "records long, skipped long, null_quality long")


def _clusters(t: Tables) -> DataFrame:
    """Distances from the mean latency, in place of those from cluster centres."""
    mean = t.perf.agg(F.avg("p95_duration_ms").alias("m"))
    return t.perf.crossJoin(F.broadcast(mean)).select("app_version", "metric_date", F.abs(F.col("p95_duration_ms") - F.col("m")).alias("centroid_distance")).filter("centroid_distance > 5000")


def _streamed(t: Tables) -> DataFrame:
    """Sessions of the events as a stream, closed by the watermark, through a file sink."""
    at = adapters.scratch(t.spark, "stream")
    source = f"{t.sf_dir}/events.parquet"
    # as a pattern, since a stream's source must otherwise be a folder
    rows = t.spark.readStream.schema(t.spark.read.parquet(source).schema).parquet(f"{t.sf_dir}/event[s].parquet")
    stream = adapters.as_interactions(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = metrics.sessions(stream, 1800).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state")
    out.trigger(availableNow=True).start(f"{at}/sessions").awaitTermination()
    return t.spark.read.parquet(f"{at}/sessions")


_CONSENSUS = """report2 AS (SELECT app_version, metric_date, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3.5 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS signal FROM report)
SELECT app_version, metric_date, 'z_score' AS method, signal FROM report2 UNION ALL
SELECT app_version, metric_date, 'kmeans', CAST(round(abs(p95_duration_ms - m), 2) AS VARCHAR) FROM perf, (SELECT avg(p95_duration_ms) AS m FROM perf) WHERE abs(p95_duration_ms - m) > 5000"""
_NUMBERS = ("total_interactions", "days_active")
_PIVOT = "pivot_ AS (SELECT cohort_week, any_value(cohort_size) AS cohort_size, " + ", ".join(f"max(retention_rate) FILTER (week_number = {w}) AS week_{w}" for w in range(13)) + " FROM coh GROUP BY 1)"


def _with(text: str, more: str) -> str:
    """``text`` with another common table expression after its own."""
    head, _, body = text.rpartition("\nSELECT")
    return f"{head},\n{more}\nSELECT{body}"


QUERIES |= {
    "rolling_active_twice": (lambda t: engagement.rolling_active(t.i, 30, 2), sql("SELECT date, count(*) AS active_users FROM (SELECT d.date, i.user_id FROM dau d JOIN i ON CAST(i.timestamp AS DATE) BETWEEN d.date - 29 AND d.date GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1", "dau")),
    "filtered_power_users": (lambda t: serving.filtered(t.power, device_type=["iPhone", "iPad", "Android Phone"], subscription_type="FURNITURE", country=None).select("user_id", "country", "device_type", "hours_spent"), sql("SELECT user_id, country, device_type, hours_spent FROM power WHERE device_type IN ('iPhone', 'iPad', 'Android Phone') AND subscription_type = 'FURNITURE'", "power")),
    "filtered_versions": (lambda t: serving.filtered(t.perf, "metric_date", AS_OF, 14, app_version="3.1.0").select("metric_date", "app_version", "count", "p95_duration_ms"), sql(f"SELECT metric_date, app_version, count, p95_duration_ms FROM perf WHERE metric_date >= DATE '{AS_OF}' - 14 AND app_version = '3.1.0'", "perf")),
    "filtered_sessions": (lambda t: serving.session_summary(serving.filtered(t.s, "session_start_time", AS_OF, 14, device_type="iPad")), sql(f"SELECT count(*) AS total_sessions, round(avg(session_duration_ms) / 1000, 2) AS avg_duration_sec, round(avg(action_count), 2) AS avg_actions_per_session, round(sum(is_bounce::INT) * 100.0 / count(*), 2) AS bounce_rate_pct FROM s WHERE session_start_time >= DATE '{AS_OF}' - 14 AND device_type = 'iPad'", "s")),
    "filtered_bounce": (lambda t: serving.filtered(t.bounce, "metric_date", AS_OF, 14, dimension_name="device_type", dimension_value=["iPhone", "Android Phone"]), sql(f"SELECT * FROM bounce WHERE metric_date >= DATE '{AS_OF}' - 14 AND dimension_name = 'device_type' AND dimension_value IN ('iPhone', 'Android Phone')", "bounce")),
    "filtered_anomalies": (lambda t: serving.filtered(t.report, severity=["low", "medium"]).select("app_version", "metric_date", "severity"), _with(sql("SELECT app_version, metric_date, CASE WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity FROM report WHERE abs(z) < 3.5", "perf"), _REPORT)),
    "anomaly_consensus": (lambda t: serving.anomaly_consensus(t.report, _clusters(t)), sql("", "perf").rstrip() + f",\n{_REPORT},\n{_CONSENSUS}"),
    "describe_durations": (lambda t: _rounded(checks.describe(t.i, "duration_ms"), mean=6, stddev=6), sql("SELECT 'duration_ms' AS column, CAST(count(duration_ms) AS DOUBLE) AS count, round(avg(duration_ms), 6) AS mean, round(stddev_samp(duration_ms), 6) AS stddev, CAST(min(duration_ms) AS DOUBLE) AS min, CAST(max(duration_ms) AS DOUBLE) AS max FROM i", "i")),
    "retention_top_countries": (lambda t: serving.retention_top_countries(t.cohseg), sql("SELECT week_number, segment_value AS country, round(avg(retention_rate) * 100, 1) AS avg_retention_pct FROM cohseg WHERE segment_type = 'country' AND segment_value IN (SELECT segment_value FROM cohseg WHERE segment_type = 'country' AND week_number = 0 GROUP BY 1 ORDER BY sum(cohort_size) DESC, 1 LIMIT 5) GROUP BY 1, 2", "cohseg")),
    "precision_recall_at_k": (lambda t: ml.at_top(_scored(t), "total_interactions", F.col("days_active") > 10, 20), sql(f"SELECT count(*) AS k, round(sum((days_active > 10)::INT) / count(*), 6) AS precision_at_k, round(sum((days_active > 10)::INT) / (SELECT count(*) FROM {_SCORED} WHERE days_active > 10), 6) AS recall_at_k FROM (SELECT * FROM {_SCORED} ORDER BY total_interactions DESC, user_id LIMIT 20)", "totals", "u")),
    "f1_at_threshold": (lambda t: ml.f1(_scored(t), F.col("total_interactions") > 12, F.col("days_active") > 10), sql(f"SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (total_interactions > 12 AND days_active > 10) AS tp, count(*) FILTER (total_interactions > 12 AND days_active <= 10) AS fp, count(*) FILTER (total_interactions <= 12 AND days_active > 10) AS fn FROM {_SCORED})", "totals", "u")),
    "size_balance": (lambda t: ml.size_balance(t.u, "country"), sql("SELECT count(*) AS segments, round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 6) AS gini, round(max(n) / sum(n), 6) AS largest_share FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*), country) AS i FROM u GROUP BY country)", "u")),
    "segment_spread": (lambda t: ml.spread(_scored(t), _NUMBERS, "subscription_type"), sql(f"SELECT subscription_type, round(stddev_samp(total_interactions), 6) AS stddev_total_interactions, round(stddev_samp(days_active), 6) AS stddev_days_active FROM {_SCORED} GROUP BY 1", "totals", "u")),
    "centre_distances": (lambda t: ml.centre_distances(_scored(t), _NUMBERS, "subscription_type"), _with(sql("SELECT a.g AS first, b.g AS second, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM m a JOIN m b ON a.g < b.g", "totals", "u"), f"m AS (SELECT subscription_type AS g, avg(total_interactions) AS x, avg(days_active) AS y FROM {_SCORED} GROUP BY 1)")),
    "centre_drift": (lambda t: ml.centre_drift(_scored(t).filter("device_type = 'iPad'"), _scored(t), _NUMBERS, "subscription_type"), _with(sql("SELECT subscription_type, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS drift FROM m a JOIN b USING (subscription_type)", "totals", "u"), f"m AS (SELECT subscription_type, avg(total_interactions) AS x, avg(days_active) AS y FROM {_SCORED} WHERE device_type = 'iPad' GROUP BY 1),\nb AS (SELECT subscription_type, avg(total_interactions) AS x, avg(days_active) AS y FROM {_SCORED} GROUP BY 1)")),
    "forecast_errors": (lambda t: ml.forecast_errors(ml.retention_pivot(t.coh), "week_2", "week_1", "cohort_size", 24, 27), _with(sql("SELECT CASE WHEN cohort_size < 24 THEN 'small' WHEN cohort_size < 27 THEN 'medium' ELSE 'large' END AS cohorts, count(*) AS n, round(sqrt(avg((week_1 - week_2) ** 2)), 6) AS rmse, round(avg(week_1 - week_2), 6) AS bias, round(avg(((week_1 > m) = (week_2 > m))::INT), 6) AS directional_accuracy, round((sqrt(avg((m - week_2) ** 2)) - sqrt(avg((week_1 - week_2) ** 2))) / nullif(sqrt(avg((m - week_2) ** 2)), 0), 6) AS gain_over_mean FROM (SELECT *, avg(week_2) OVER () AS m FROM pivot_) GROUP BY 1", "coh"), _PIVOT)),
    "forecast_rows": (lambda t: ml.usable(ml.retention_pivot(retention.cohort_retention(t.i, t.u, periods=9), 9))[0].select("cohort_week", "week_4", "week_8"), _with(sql("SELECT cohort_week, week_4, week_8 FROM pivot_ WHERE week_0 IS NOT NULL AND week_1 IS NOT NULL AND week_2 IS NOT NULL AND week_4 IS NOT NULL AND week_8 IS NOT NULL", "coh"), _PIVOT)),
    "feature_stats": (lambda t: _rounded(ml.feature_stats(_scored(t), *_NUMBERS), total_interactions_mean=6, total_interactions_stddev=6, days_active_mean=6, days_active_stddev=6), sql(f"SELECT round(avg(total_interactions), 6) AS total_interactions_mean, round(stddev_samp(total_interactions), 6) AS total_interactions_stddev, round(avg(days_active), 6) AS days_active_mean, round(stddev_samp(days_active), 6) AS days_active_stddev FROM {_SCORED}", "totals", "u")),
    "feature_drift": (lambda t: ml.feature_drift(t.dau.select(F.col("date").alias("run_date"), "daily_active_users"), "daily_active_users"), sql("SELECT date AS run_date, daily_active_users, coalesce(abs(daily_active_users - avg(daily_active_users) OVER w) > 2 * stddev_samp(daily_active_users) OVER w, false) AS drifted FROM dau WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)", "dau")),
    "detection_rate": (lambda t: ml.detection_rate(t.anom, t.events, "event_type"), sql("SELECT event_type, count(*) AS rows, count(a.event_id) AS flagged, round(count(a.event_id) / count(*), 6) AS rate FROM events e LEFT JOIN (SELECT event_id FROM anom) a USING (event_id) GROUP BY 1", "anom")),
    "psi": (lambda t: ml.psi(t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1"), "event_type"), "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT event_type, count(*) FILTER (event_id % 2 = 0) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS e, count(*) FILTER (event_id % 2 = 1) / (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS a FROM events GROUP BY 1)"),
    "join_explicit_hot": (lambda t: joins.optimized_join(_lines(t), _suppliers(t), "s_suppkey", "left", hot=joins.hot_keys(_lines(t), "s_suppkey", 0.9)), f"SELECT {_LINES} FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey"),
    "join_detected_hot": (lambda t: joins.optimized_join(_lines(t), _suppliers(t), "s_suppkey", "inner", enable_broadcast=False, skew_percentile=0.9), f"SELECT {_LINES} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "join_right": (lambda t: joins.optimized_join(_lines(t).filter("s_suppkey > 3"), _suppliers(t), "s_suppkey", "right", enable_broadcast=False), f"SELECT {_LINES} FROM (SELECT * FROM lineitem WHERE l_suppkey > 3) RIGHT JOIN supplier ON l_suppkey = s_suppkey"),
    "join_full": (lambda t: joins.salted_join(_lines(t).filter("s_suppkey > 3"), _suppliers(t).filter("s_suppkey < 8"), "s_suppkey", joins.hot_keys(_lines(t), "s_suppkey", 0.9), "full"), "SELECT l_orderkey, l_linenumber, coalesce(l_suppkey, s_suppkey) AS s_suppkey, s_name FROM (SELECT * FROM lineitem WHERE l_suppkey > 3) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey < 8) ON l_suppkey = s_suppkey"),
    "csv_round_trip": (_csv, sql("SELECT * FROM u", "u")),
    "parquet_by_date": (_by_date, sql("SELECT *, CAST(timestamp AS DATE) AS date FROM \"full\" WHERE CAST(timestamp AS DATE) = DATE '2024-01-05'", "full")),
    "jdbc_table": (lambda t: _named(jdbc.read_table(t.spark, "accounts", column="ID", lower=0, upper=2000, num_partitions=3, at=_database(t))), "SELECT c_custkey AS id, c_acctbal::DOUBLE AS balance, c_nationkey::INT AS nation FROM customer UNION ALL SELECT c_custkey, c_acctbal::DOUBLE, c_nationkey::INT FROM customer WHERE c_nationkey = 3"),
    "jdbc_query": (lambda t: _named(jdbc.read_query(t.spark, "SELECT * FROM accounts WHERE \"NATION\" < 5;", _database(t))), "SELECT c_custkey AS id, c_acctbal::DOUBLE AS balance, c_nationkey::INT AS nation FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_acctbal::DOUBLE, c_nationkey::INT FROM customer WHERE c_nationkey = 3"),
    "jdbc_count": (lambda t: t.spark.createDataFrame([(jdbc.row_count(t.spark, "accounts", _database(t)),)], "n long"), "SELECT count(*) + count(*) FILTER (c_nationkey = 3) AS n FROM customer"),
    "validation_warnings": (_validated, "SELECT c || ' has ' || n || ' nulls' AS warning FROM (SELECT count(*) FILTER (quality IS NULL) AS q, count(*) FILTER (toxic IS NULL) AS x FROM documents LEFT JOIN labels USING (doc_id)) UNPIVOT (n FOR c IN (q AS quality, x AS toxic)) WHERE n > 0"),
    "schema_errors": (_schema_errors, "SELECT unnest(['missing column: page_id', 'duration_ms is bigint, not int', 'unexpected column: more']) AS error"),
    "observed_counts": (_observed, sql("SELECT count(*) AS rows, count(*) FILTER (user_id IS NULL) AS null_user_id, count(*) FILTER (country IS NULL) AS null_country, count(*) FILTER (duration_ms < 0) AS negative_duration_ms FROM \"full\"", "full")),
    "accumulated_errors": (_accumulated, "SELECT count(quality) AS records, count(*) - count(quality) AS skipped, count(*) - count(quality) AS null_quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "job_process": (lambda t: jobs.process(t.i, t.u)["enriched_interactions"].drop("processing_timestamp"), sql('SELECT *, CAST(timestamp AS DATE) AS date FROM "full"', "full")),
    "job_engagement": (lambda t: jobs.engage(t.full)["daily_active_users"], sql("SELECT * FROM dau", "dau")),
    "job_performance": (lambda t: _rounded(jobs.perform(t.full)["device_correlation"], f_statistic=6, eta_squared=9), sql("SELECT * REPLACE (round(f_statistic, 6) AS f_statistic, round(eta_squared, 9) AS eta_squared) FROM corr", "corr")),
    "job_sessions": (lambda t: jobs.sessionize(t.full, run_date=RUN_DATE)["session_metrics"], sql("SELECT session_id, user_id, session_start_time, session_end_time, session_duration_ms, action_count AS actions_count, avg_action_duration_ms, is_bounce::INT AS is_bounce, device_type, country FROM s", "s", gap=600)),
    "summary_engagement": (lambda t: jobs.dau_summary(t.dau).crossJoin(F.broadcast(jobs.retention_summary(t.coh))), sql("SELECT avg(daily_active_users) AS avg_dau, max(daily_active_users) AS max_dau, min(daily_active_users) AS min_dau, any_value(w0) AS w0, any_value(w12) AS w12 FROM dau, (SELECT round(avg(retention_rate) FILTER (week_number = 0), 9) AS w0, round(avg(retention_rate) FILTER (week_number = 12), 9) AS w12 FROM coh)", "dau", "coh")),
    "summary_countries": (lambda t: jobs.distribution(t.freq, "country", 5), sql("SELECT country, count(*) AS n FROM freq GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "freq")),
    "summary_return": (lambda t: jobs.return_rate(t.freq), sql("SELECT count(*) FILTER (total_sessions > 1) AS return_users, round(count(*) FILTER (total_sessions > 1) * 100.0 / count(*), 2) AS return_rate FROM freq", "freq")),
    "summary_actions": (lambda t: jobs.distribution(t.i, "action_type"), sql("SELECT action_type, count(*) AS n FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "i")),
    "stream_sessions": (_streamed, sql("SELECT user_id, session_start_time, session_end_time, action_count, total_action_duration_ms, is_bounce FROM s WHERE session_end_time <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR", "s", gap=1800)),
    "percentile_anomalies": (lambda t: ml.percentile_anomalies(t.perf, "app_version", AS_OF, "1"), None),
    "segment_profiles": (lambda t: ml.segment_tables(ml.segments(ml.segment_features(t.freq, t.power, t.u)), t.s, AS_OF, "1")[1], None),
    "user_churn_scores": (lambda t: ml.churn_table(ml.churn(ml.churn_features(t.s, t.u)).scores, AS_OF, "1"), None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for name, (_, s) in QUERIES.items() if s}
