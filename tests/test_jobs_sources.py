from datetime import date, datetime, timedelta
from unittest import mock

import pytest
from pyspark.sql import functions as F

from pulsegrid import monitoring, schema, session
from pulsegrid.plans import jobs, ml
from pulsegrid.sources import files, generator, jdbc
from pulsegrid.streaming import metrics


@pytest.fixture
def postgres(monkeypatch):
    monkeypatch.setenv("POSTGRES_PASSWORD", "secret")
    monkeypatch.setenv("POSTGRES_HOST", "db")


def test_jobs_end_to_end(spark, tmp_path):
    i, u = generator.interactions(spark, 3000, 60, days=30, hot_share=0.2), generator.users(spark, 60, days=20)
    i.write.csv(str(tmp_path / "i"), header=True)
    u.write.csv(str(tmp_path / "u"), header=True)
    out = str(tmp_path / "out")
    assert jobs.main(["process", "--interactions", str(tmp_path / "i"), "--metadata", str(tmp_path / "u"), "--output", out], spark) == 0
    enriched = files.read_parquet(spark, f"{out}/enriched_interactions")
    assert enriched.count() == 3000 and enriched.filter("country IS NULL").count() == 0
    for job, tables in (("engagement", 6), ("performance", 4), ("sessions", 3)):
        assert jobs.main([job, "--input", f"{out}/enriched_interactions", "--output", f"{tmp_path}/{job}"], spark) == 0
        assert len(list((tmp_path / job).iterdir())) == tables
    assert spark.read.parquet(f"{tmp_path}/engagement/daily_active_users").agg(F.sum("total_interactions")).head()[0] == 3000
    s = spark.read.parquet(f"{tmp_path}/sessions/session_metrics")
    assert s.agg(F.sum("actions_count")).head()[0] == 3000
    assert jobs.session_lengths(s).agg(F.sum("sessions")).head()[0] == s.count()
    assert jobs.return_rate(spark.read.parquet(f"{tmp_path}/sessions/session_frequency")).head().return_users > 0
    assert jobs.anova_summary(spark.read.parquet(f"{tmp_path}/performance/device_correlation")).head().effect in ("negligible", "small", "medium", "large")
    assert jobs.dau_summary(spark.read.parquet(f"{tmp_path}/engagement/daily_active_users")).head().max_dau <= 60
    assert jobs.distribution(enriched, "action_type").count() == 4


def test_unmatched_users_stay_and_failures_return_one(spark, tmp_path):
    i = spark.createDataFrame([("x", datetime(2024, 1, 1), "VIEW", "p", 1, "1")], schema.INTERACTIONS)
    u = spark.createDataFrame([], schema.USERS)
    r = jobs.process(i, u)["enriched_interactions"].head()
    assert r.user_id == "x" and r.country is None and r.date == date(2024, 1, 1)
    assert jobs.main(["sessions", "--input", str(tmp_path / "none")], spark) == 1


def test_generator_repeats_itself(spark):
    a, b = generator.interactions(spark, 100, 10), generator.interactions(spark, 100, 10)
    assert a.exceptAll(b).count() == 0


def test_jdbc_reads(postgres):
    spark = mock.MagicMock()
    jdbc.read_table(spark, "t")
    args, kwargs = spark.read.jdbc.call_args
    assert args == ("jdbc:postgresql://db:5432/analytics", "t") and kwargs["properties"]["stringtype"] == "unspecified"
    jdbc.read_table(spark, "t", predicates=["a = 1"])
    assert spark.read.jdbc.call_args.kwargs["predicates"] == ["a = 1"]
    jdbc.read_table(spark, "t", column="id", lower=0, upper=9, num_partitions=3)
    assert spark.read.jdbc.call_args.kwargs["numPartitions"] == 3
    with pytest.raises(ValueError):
        jdbc.read_table(spark, "t", column="id")
    with pytest.raises(ValueError):
        jdbc.read_table(spark, "t", ["a"], "id", 0, 9, 3)
    jdbc.read_query(spark, "SELECT 1;")
    assert spark.read.jdbc.call_args.args[1] == "(SELECT 1) as query"
    spark.read.jdbc.return_value.head.return_value = None
    assert jdbc.row_count(spark, "t") == 0
    with pytest.raises(ValueError):
        jdbc.row_count(spark, "t; DROP TABLE t")


def test_jdbc_writes(postgres):
    df = mock.MagicMock()
    jdbc.write_table(df, "t", num_partitions=4)
    df.repartition.assert_called_once_with(4)
    kwargs = df.repartition.return_value.write.jdbc.call_args.kwargs
    assert kwargs["mode"] == "append" and kwargs["properties"]["batchsize"] == "10000" and kwargs["properties"]["isolationLevel"] == "READ_COMMITTED"
    assert jdbc.write_tables({"a": df, "b": df}, {"a": "ta"}) == ["a"]
    assert "dbname=analytics" in jdbc.libpq() and jdbc.config_ok()


def test_jdbc_needs_a_password(monkeypatch):
    monkeypatch.delenv("POSTGRES_PASSWORD", raising=False)
    with pytest.raises(ValueError):
        jdbc.connection()
    assert not jdbc.config_ok()


def test_csv_is_permissive(spark, tmp_path):
    (tmp_path / "x.csv").write_text("user_id,timestamp,action_type,page_id,duration_ms,app_version\nu,2024-01-01 00:00:00,VIEW,p,z,1\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), schema.INTERACTIONS).head().duration_ms is None
    assert files.read_csv(spark, str(tmp_path / "x.csv"), num_partitions=2).columns == schema.required(schema.INTERACTIONS)


def test_session_tools(spark):
    assert session.optimal_partitions(spark, 100) == 800
    assert session.optimal_partitions(spark, 0.001) == 2 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.configure_job(spark, "nothing")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    session.configure_job(spark, "ml")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "512MB"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert session.config_summary(spark)["spark.sql.shuffle.partitions"] == before


def test_monitoring(spark):
    ctx = monitoring.context(spark.sparkContext, "job")
    assert monitoring.track_errors({"a": 1, "n": 2}, ctx, ["a"], ["n"])
    assert not monitoring.track_errors({"a": None, "n": -2}, ctx, ["a"], ["n"])
    assert ctx.errors.value == {"null_a": 1, "negative_n": 1}
    spark.sparkContext.parallelize([1] * 9, 2).mapPartitions(lambda p: monitoring.track_partition(p, ctx)).count()
    assert ctx.partitions.value == {"max": 5, "min": 4, "count": 2}
    ctx.records.add(9)
    text = monitoring.summary(ctx)
    assert "records 9" in text and "skew 1.25" in text
    df, seen = monitoring.observed(spark.createDataFrame([("a", -1), (None, 1)], "u string, n int"), ["u"], ["n"])
    df.collect()
    assert seen.get == {"rows": 2, "null_u": 1, "negative_n": 1}
    assert monitoring.profile("none") == monitoring.profile("standard") and monitoring.profile("strict")["fail_on_errors"]
    found = monitoring.with_monitoring("x")(lambda s, ctx=None: ctx.job)(spark)
    assert found == "x"
    assert monitoring.partition_sizes(spark.range(10).repartition(2)).head().partitions == 2


def test_streaming_matches_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"u{i % 3}", t + timedelta(minutes=20 * i), 5) for i in range(60)] + [("late", t + timedelta(days=30), 1)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp, duration_ms int").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = metrics.sessions(stream, 1800).writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("s").filter("user_id <> 'late'").count() == 60
    q = metrics.daily_active(stream).writeStream.format("memory").queryName("d").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("d").filter("date = '2024-01-01'").head().total_interactions == 60


def test_model_monitoring(spark):
    runs = spark.createDataFrame([(date(2024, 1, d), 10.0 + d % 2) for d in range(1, 20)] + [(date(2024, 1, 25), 99.0)], "run_date date, m double")
    assert [r.run_date.day for r in ml.feature_drift(runs, "m").filter("drifted").collect()] == [25]
    a = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5, "k string")
    assert ml.psi(a, a, "k").head().psi == 0.0
    with pytest.raises(ValueError):
        ml.forecast(spark.createDataFrame([(1,)], "week_1 int"))


def test_churn_metrics_and_profiles(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("user_id"), F.lit("d").alias("device_type"), F.lit("c").alias("country"), F.lit("s").alias("subscription_type"), (F.col("id") % 10).alias("total_sessions"),
        F.lit(1.0).alias("avg_session_ms"), F.col("id").alias("total_actions"), F.lit(0.5).alias("bounce_share"), (F.col("id") % 10 < 5).cast("int").alias("churned"),
    )
    found = ml.churn(rows, 3, 2, evaluate=True)
    assert found.metrics["areaUnderROC"] > 0.9 and found.metrics["feasible"] == 1.0 and found.scores.count() == 200
    assert max(found.importances, key=found.importances.get) == "total_sessions"
