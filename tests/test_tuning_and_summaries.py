import logging
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid import monitoring, schema, session
from pulsegrid.operators import checks, engagement, performance, sessions
from pulsegrid.operators.ranks import once, ranked
from pulsegrid.plans import jobs, ml, serving
from pulsegrid.sources import generator


@pytest.fixture
def conf(spark):
    keys = {k for p in session.PROFILES.values() for k in p} | {"spark.sql.shuffle.partitions"}
    before = {k: spark.conf.get(k, None) for k in keys}
    yield spark.conf
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("kind,mb", [("etl", 128), ("analytics", 256), ("ml", 512)])
def test_partition_size_by_kind(spark, conf, kind, mb):
    session.configure_job(spark, kind, 100)
    assert int(conf.get("spark.sql.shuffle.partitions")) == 100 * 1024 // mb


def test_streams_keep_their_partitions(spark, conf):
    conf.set("spark.sql.shuffle.partitions", "7")
    session.configure_job(spark, "streaming", 100)
    assert conf.get("spark.sql.shuffle.partitions") == "7" and "StateStoreProvider" in conf.get("spark.sql.streaming.stateStore.providerClass")


def test_session_options(monkeypatch):
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def config(self, map):
            seen.update(map)
            return self

        def master(self, where):
            seen["master"] = where
            return self

        def getOrCreate(self):
            return self

        sparkContext = type("C", (), {"setLogLevel": staticmethod(lambda level: None)})

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    monkeypatch.setenv("SPARK_EXECUTOR_CORES", "9")
    monkeypatch.setenv("SPARK_SHUFFLE_PARTITIONS", "33")
    session.create_session(master="local[1]", **{"spark.executor.instances": "5"})
    assert (seen["spark.executor.cores"], seen["spark.sql.shuffle.partitions"], seen["spark.executor.instances"], seen["spark.executor.memory"]) == ("9", "33", "5", "4g")
    assert seen["spark.sql.cbo.enabled"] == "true" and seen["spark.sql.adaptive.skewJoin.skewedPartitionFactor"] == "5" and seen["master"] == "local[1]"
    assert "spark.executor.cores" in session.SUMMARY


def test_profiles_decide_what_is_recorded(spark):
    assert [monitoring.profile(p)["skew_threshold"] for p in ("strict", "standard", "minimal", "other")] == [3.0, 5.0, 10.0, 5.0]
    df = spark.createDataFrame([("a", 1), (None, -1), ("c", 2)], "u string, n int")

    def seen():
        out, x = monitoring.observed(df, ["u"], ["n"])
        out.collect()
        return x

    ctx = monitoring.context(spark.sparkContext, "j")
    monitoring.record(ctx, seen(), monitoring.profile("standard"))
    assert (ctx.records.value, ctx.errors.value) == (3, {"null_u": 1, "negative_n": 1})
    ctx = monitoring.context(spark.sparkContext, "j")
    monitoring.record(ctx, seen(), monitoring.profile("minimal"))
    assert (ctx.records.value, ctx.errors.value) == (3, {})
    with pytest.raises(monitoring.QualityError, match="null_u: 1"):
        monitoring.record(ctx, seen(), monitoring.profile("strict"))
    ctx.partitions.add({"max": 8, "min": 2, "count": 2})
    assert "above 3" in monitoring.summary(ctx, 3.0) and "above" not in monitoring.summary(ctx, 5.0)


def test_jobs_count_records_and_sum_up(spark, tmp_path, caplog):
    generator.write_csv({"i": generator.interactions(spark, 2000, 40), "u": generator.users(spark, 40)}, str(tmp_path))
    caplog.set_level(logging.INFO)
    run = lambda *args: jobs.main([*args, "--dev-mode"], spark)
    assert run("process", "--interactions", f"{tmp_path}/i", "--metadata", f"{tmp_path}/u", "--output", f"{tmp_path}/out") == 0
    assert "records 2000" in caplog.text and "process, actions: action_type VIEW" in caplog.text
    for job, line in (("engagement", "engagement, retention: w0"), ("performance", "performance, devices: f_statistic"), ("sessions", "sessions, countries: country")):
        caplog.clear()
        assert run(job, "--input", f"{tmp_path}/out/enriched_interactions") == 0
        assert line in caplog.text and "records 2000" in caplog.text
    assert run("performance", "--input", f"{tmp_path}/none") == 1


def test_performance_job_validates(spark, caplog):
    df = generator.interactions(spark, 50, 5).join(generator.users(spark, 5), "user_id", "left")
    jobs.perform(df.withColumn("duration_ms", F.when(F.col("duration_ms") % 2 == 0, F.col("duration_ms"))))
    assert "duration_ms has" in caplog.text
    with pytest.raises(ValueError, match="app_version"):
        jobs.perform(df.drop("app_version"))


def test_generated_values_have_their_shares(spark):
    n = 20_000
    events = generator.interactions(spark, n, 500, realistic=True)
    share = {r.action_type: r["count"] / n for r in events.groupBy("action_type").count().collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in generator.ACTIONS.items())
    people = generator.users(spark, n)
    for column, shares in (("device_type", generator.DEVICES), ("country", generator.COUNTRIES), ("subscription_type", generator.PLANS)):
        got = {r[0]: r[1] / n for r in people.groupBy(column).count().collect()}
        assert all(abs(got[k] - v) < 0.02 for k, v in shares.items())
    late = events.filter(F.dayofyear("timestamp") > 340).select("app_version").distinct().collect()
    assert [r[0] for r in late] == ["3.2.0"] and {r[0] for r in events.filter(F.dayofyear("timestamp") < 40).select("app_version").distinct().collect()} == {"3.0.0", "3.0.1"}
    by = events.join(generator.users(spark, 500), "user_id").groupBy("subscription_type").agg(F.avg(F.dayofweek("timestamp").isin(1, 7).cast("int")).alias("free"), F.avg(F.hour("timestamp").between(8, 15).cast("int")).alias("work"))
    rows = {r.subscription_type: r for r in by.collect()}
    assert rows["enterprise"].free < 0.15 < rows["free"].free and rows["enterprise"].work > 0.6 > rows["free"].work
    assert [x.name for x in schema.INTERACTIONS] == events.columns


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_ranks_are_those_of_a_global_sort(spark, n):
    rows = [(f"u{i:04d}", None if i % 50 == 49 else (i * 37) % 60) for i in range(n)]
    got = {r.u: (r._rank, r._n) for r in ranked(spark.createDataFrame(rows, "u string, v int").repartition(3), "v", "u").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {u: (i + 1, n) for i, (u, _) in enumerate(order)}


def test_power_users_beyond_a_limit_have_no_rank(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"u{i}", t, 10 * i) for i in range(40)], "user_id string, timestamp timestamp, duration_ms int")
    assert all(r.percentile_rank is not None for r in engagement.power_users(df, percentile=0.5).collect())
    assert all(r.percentile_rank is None for r in engagement.power_users(df, percentile=0.5, most_ranked=3).collect())


def test_a_filter_on_start_cuts_no_session_short(spark):
    t = datetime(2024, 1, 1, 23, 50)
    rows = [("u", t + timedelta(minutes=5 * i), 7) for i in range(6)] + [("v", t + timedelta(hours=3), 7)]
    found = sessions.session_metrics(spark.createDataFrame(rows, "user_id string, timestamp timestamp, duration_ms int"), 600)
    assert [(r.user_id, r.action_count) for r in serving.filtered(found, "session_start_time", "2024-01-02", 0).collect()] == [("v", 1)]


def test_filters_choose_all_by_default(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    assert serving.filtered(df, k=None).count() == 3 and serving.filtered(df, k="a").count() == 1 and serving.filtered(df, k=["a", "b"], n=2).count() == 1


def test_describe_and_one_pass_device_performance(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    assert [(r.column, r["count"], r.mean, r.min) for r in checks.describe(df, "a", "b").collect()] == [("a", 2.0, 2.0, 1.0), ("b", 1.0, 2.0, 2.0)]
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([("u", t, 5, "d"), ("u", t, 7, "d"), ("w", t, 9, "d")], "user_id string, timestamp timestamp, duration_ms int, device_type string")
    out = performance.device_performance(events)
    assert (out.head().user_count, out.head()["count"]) == (2, 3)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_once_reads_its_input_once(spark):
    hits = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            hits.add(b.num_rows)
            yield b

    df = once(spark.range(10).mapInArrow(seen, "id long"))
    df.count(), df.count()
    assert hits.value in (10, 20)  # 20 without a checkpoint folder


def test_model_tables_have_their_columns(spark):
    found = spark.createDataFrame([(f"u{i}", i % 3, 5, 2, 1.0, 3.0 * (i % 3), 4, "free") for i in range(30)], "user_id string, segment int, total_sessions int, active_days int, avg_sessions_per_day double, hours_spent double, total_interactions int, subscription_type string")
    log = spark.createDataFrame([(f"u{i}", 1000, 2, i % 2 == 0) for i in range(30)], "user_id string, session_duration_ms int, action_count int, is_bounce boolean")
    users, profiles = ml.segment_tables(found, log, "2024-02-01", "v1")
    assert tuple(users.columns) == ml.TABLES["user_segments"] and tuple(profiles.columns) == ml.TABLES["segment_profiles"]
    assert {(r.segment_id, r.segment_name, r.user_count) for r in profiles.collect()} == {(2, "engagement 1", 10), (1, "engagement 2", 10), (0, "engagement 3", 10)}
    scores = spark.createDataFrame([("u", 0.25, 0, 1)], "user_id string, churn_probability double, predicted int, churned int")
    assert tuple(ml.churn_table(scores, "2024-02-01", "v1").head()) [:3] == ("u", 0.25, 0)
    forecasts = spark.createDataFrame([(datetime(2024, 1, 1).date(), 0.5, 0.4, 0.3)], "cohort_week date, actual double, forecast double, baseline double")
    assert ml.forecast_table(forecasts, 12, "LinearRegression", 0.1, "2024-02-01", "v1").head().predicted_retention == 0.4
