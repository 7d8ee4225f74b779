"""Churn, segmentation, clustering anomalies and retention forecasts with pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import once, ranked

SEED = 42
CHURN_NUMBERS = ("total_sessions", "avg_session_ms", "total_actions", "bounce_share")
CATEGORIES = ("device_type", "country", "subscription_type")
SEGMENT_NUMBERS = ("total_sessions", "active_days", "avg_sessions_per_day", "hours_spent", "total_interactions")


def churn_features(sessions: DataFrame, users: DataFrame, away_days: int = 30) -> DataFrame:
    """Per user: session counts and shares, tenure, and whether the last session is over ``away_days`` before the last of all."""
    day = F.to_date("session_start_time")
    per = sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.avg("session_duration_ms").alias("avg_session_ms"), F.sum("action_count").alias("total_actions"),
        F.avg(F.col("is_bounce").cast("int")).alias("bounce_share"), F.count_distinct(day).alias("active_days"), F.max(day).alias("last_seen"),
    )
    last = sessions.agg(F.max(day).alias("last_day"))  # one row
    rows = per.join(users, "user_id").crossJoin(F.broadcast(last))
    tenure = F.datediff("last_seen", F.col("registration_date").cast("date")).cast("long")
    away = (F.datediff("last_day", "last_seen") > away_days).cast("int")
    return rows.select("user_id", *CATEGORIES, *CHURN_NUMBERS, "active_days", tenure.alias("tenure_days"), away.alias("churned"))


@dataclass
class Churn:
    scores: DataFrame
    metrics: dict[str, float]
    importances: dict[str, float]
    confusion: DataFrame


def churn(features: DataFrame, trees: int = 50, depth: int = 5, evaluate: bool = False, min_auc: float = 0.7) -> Churn:
    """Gradient-boosted trees on four numbers and three categories; scores for all users, measured on a fifth held out.

    A user is held out by the hash of its id, so a rerun splits alike.
    """
    features = once(features)  # read by every tree
    held = F.pmod(F.xxhash64("user_id"), F.lit(5)) == 0
    names = [*CHURN_NUMBERS, *(f"{c}_i" for c in CATEGORIES)]
    steps = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORIES]
    steps += [VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(labelCol="churned", maxIter=trees, maxDepth=depth, maxBins=64, seed=SEED)]
    model = Pipeline(stages=steps).fit(features.filter(~held))
    out = model.transform(features)
    metrics, confusion = {}, out.filter(held).groupBy("churned").pivot("prediction", [0.0, 1.0]).count()
    if evaluate:
        test = out.filter(held)
        for name in ("areaUnderROC", "areaUnderPR"):
            metrics[name] = BinaryClassificationEvaluator(labelCol="churned", metricName=name).evaluate(test)
        for name in ("accuracy", "f1"):
            metrics[name] = MulticlassClassificationEvaluator(labelCol="churned", metricName=name).evaluate(test)
        metrics["feasible"] = float(metrics["areaUnderROC"] >= min_auc)
    scores = out.select("user_id", F.round(vector_to_array("probability")[1], 6).alias("churn_probability"), F.col("prediction").cast("int").alias("predicted"), "churned")
    return Churn(scores, metrics, dict(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True)), confusion)


def segment_features(frequency: DataFrame, power: DataFrame, users: DataFrame) -> DataFrame:
    top = power.select("user_id", "hours_spent", "total_interactions")
    rows = frequency.join(users.select("user_id", "subscription_type"), "user_id").join(top, "user_id", "left")
    return rows.select("user_id", "total_sessions", "active_days", "avg_sessions_per_day", F.coalesce("hours_spent", F.lit(0.0)).alias("hours_spent"), F.coalesce("total_interactions", F.lit(0)).cast("long").alias("total_interactions"), "subscription_type")


def segments(features: DataFrame, ks: tuple[int, ...] = (3, 4, 5, 6, 7), numbers: tuple[str, ...] = SEGMENT_NUMBERS) -> DataFrame:
    """Each user's cluster, with the k of the best silhouette."""
    features = once(features)  # read by every iteration of every k
    scaled = Pipeline(stages=[VectorAssembler(inputCols=list(numbers), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(features).transform(features)
    tried = []
    for k in ks:
        out = KMeans(k=k, seed=SEED).fit(scaled).transform(scaled)
        tried.append((ClusteringEvaluator().evaluate(out), -k, out))
    best = max(tried, key=lambda x: x[:2])
    return best[2].select("user_id", *numbers, "subscription_type", F.col("prediction").alias("segment"))


def segment_profiles(found: DataFrame, numbers: tuple[str, ...] = SEGMENT_NUMBERS) -> DataFrame:
    """Means per segment and the share of each subscription type."""
    size = F.count(F.lit(1)).alias("users")
    return found.groupBy("segment").agg(size, *[F.avg(c).alias(f"avg_{c}") for c in numbers])


def subscription_mix(found: DataFrame) -> DataFrame:
    n = found.groupBy("segment", "subscription_type").agg(F.count(F.lit(1)).alias("users"))
    return n.withColumn("pct", F.round(F.col("users") * 100.0 / F.sum("users").over(Window.partitionBy("segment")), 1))


def _with_distance(model: KMeansModel, prepared: DataFrame) -> DataFrame:
    """Adds the cluster and the distance to its centre, an array expression."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gap = F.zip_with(vector_to_array("features"), F.get(centres, F.col("prediction")), lambda a, b: (a - b) * (a - b))
    return model.transform(prepared).withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)))


def kmeans_anomalies(interactions: DataFrame, k: int = 3, percentile: float = 0.99, largest: float = 0.9) -> DataFrame:
    """Durations whose distance to their cluster's centre is at or above a percentile. The distance is an array expression, not a UDF."""
    rows = interactions.filter("duration_ms IS NOT NULL").withColumn("log_duration", F.log1p(F.col("duration_ms").cast("double")))
    prepared = Pipeline(stages=[VectorAssembler(inputCols=["log_duration"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(rows).transform(rows)
    model = KMeans(k=k, seed=SEED).fit(prepared)
    sizes = model.summary.clusterSizes
    if max(sizes) > largest * sum(sizes):
        raise ValueError("one cluster holds nearly all rows")
    out = _with_distance(model, prepared)
    cut = out.agg(F.percentile_approx("distance", percentile, 100_000).alias("cut"))  # one row
    flagged = out.crossJoin(F.broadcast(cut)).filter(F.col("distance") >= F.col("cut"))
    return flagged.select("user_id", "metric_date", "app_version", "duration_ms", F.col("prediction").alias("cluster"), F.round("distance", 6).alias("distance"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows are in both, only the first, only the second."""
    keys = a.columns
    both = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("_a", F.lit(2)))
    per = both.groupBy(*keys).agg(F.max(F.col("_a") == 1).alias("_x"), F.max(F.col("_a") == 2).alias("_y"))
    return per.agg(F.count_if(F.col("_x") & F.col("_y")).alias("both_methods"), F.count_if(F.col("_x") & ~F.col("_y")).alias("only_first"), F.count_if(~F.col("_x") & F.col("_y")).alias("only_second"))


def retention_pivot(cohorts: DataFrame, weeks: int = 13) -> DataFrame:
    """One row per cohort with week_0 .. week_<n>; the week names are given, so no pass looks for them."""
    wide = cohorts.groupBy("cohort_week").agg(F.max("cohort_size").alias("cohort_size"), *[F.max(F.when(F.col("week_number") == w, F.col("retention_rate"))).alias(f"week_{w}") for w in range(weeks)])
    return wide


FORECAST = ("week_0", "week_1", "week_2", "week_4", "cohort_size")


def usable(pivot: DataFrame, target: str = "week_12", features: tuple[str, ...] = FORECAST) -> tuple[DataFrame, str]:
    """The cohorts without nulls, and the target: week 8 where week 12 is not there."""
    target = target if target in pivot.columns else "week_8"
    if target not in pivot.columns:
        raise ValueError("neither week 12 nor week 8 is there")
    return pivot.dropna(subset=[target, *features]), target


def forecast(pivot: DataFrame, target: str = "week_12", features: tuple[str, ...] = FORECAST) -> DataFrame:
    """Linear regression or boosted trees, by root mean squared error on the latest fifth of cohorts, against the mean; clipped to 0 .. 1."""
    rows, target = usable(pivot, target, features)
    rows = rows.withColumn("_at", F.percent_rank().over(Window.orderBy("cohort_week")))  # one row per cohort
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.withColumn("cohort_size", F.col("cohort_size").cast("double")))
    train, test = rows.filter("_at < 0.8"), rows.filter("_at >= 0.8")
    rmse = RegressionEvaluator(labelCol=target, metricName="rmse")
    models = [LinearRegression(labelCol=target).fit(train), GBTRegressor(labelCol=target, maxIter=50, maxDepth=4, seed=SEED).fit(train)]
    mean = train.agg(F.avg(target).alias("mean"))
    best = min(models, key=lambda m: rmse.evaluate(m.transform(test)))
    out = best.transform(rows).crossJoin(F.broadcast(mean))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return out.select("cohort_week", F.col(target).alias("actual"), F.round(clipped, 6).alias("forecast"), F.round("mean", 6).alias("baseline"))


def lift(rows: DataFrame, score: str, hit: Column, buckets: int = 5) -> DataFrame:
    """Hit rate by score bucket over the overall rate. Buckets have equal sizes, the first ones a row more; ties go by user_id."""
    placed = ranked(rows.select(F.col(score).alias("_s"), "user_id", hit.cast("int").alias("_hit")), "_s", "user_id")
    size, more, i = F.expr(f"_n div {buckets}"), F.col("_n") % buckets, F.col("_rank") - 1
    wide = more * (size + 1)  # rows of the larger buckets
    bucket = F.when(i < wide, F.call_function("div", i, size + 1)).otherwise(more + F.call_function("div", i - wide, F.greatest(size, F.lit(1)))) + 1
    per = placed.withColumn("bucket", bucket.cast("int")).groupBy("bucket").agg(F.count(F.lit(1)).alias("users"), F.avg("_hit").alias("_r"))
    every = Window.partitionBy(F.lit(0))
    overall = F.sum(F.col("users") * F.col("_r")).over(every) / F.sum("users").over(every)
    return per.select("bucket", "users", F.round("_r", 6).alias("rate"), F.round(F.try_divide(F.col("_r"), overall), 4).alias("lift"))


def at_top(rows: DataFrame, score: str, hit: Column, k: int) -> DataFrame:
    """Precision and recall among the ``k`` rows with the highest scores, ties by user_id. One row."""
    top = rows.select(F.col(score).alias("_s"), "user_id", hit.alias("_hit")).orderBy(F.desc("_s"), "user_id").limit(k)
    found = top.agg(F.count(F.lit(1)).alias("k"), F.count_if("_hit").alias("hits"))
    every = rows.agg(F.count_if(hit).alias("all_hits"))
    out = found.crossJoin(F.broadcast(every))
    return out.select("k", F.round(F.try_divide("hits", "k"), 6).alias("precision_at_k"), F.round(F.try_divide("hits", "all_hits"), 6).alias("recall_at_k"))


def f1(rows: DataFrame, predicted: Column, hit: Column) -> DataFrame:
    """Precision, recall and their harmonic mean. One row."""
    n = rows.agg(F.count_if(predicted & hit).alias("tp"), F.count_if(predicted & ~hit).alias("fp"), F.count_if(~predicted & hit).alias("fn"))
    r = lambda c: F.round(c, 6)
    return n.select(r(F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"), r(F.try_divide("tp", F.col("tp") + F.col("fn"))).alias("recall"), r(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def size_balance(found: DataFrame, by: str = "segment") -> DataFrame:
    """Gini coefficient of the groups' sizes, their number and the largest one's share. One row."""
    sizes = found.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each group
    placed = sizes.select("n", F.row_number().over(every.orderBy("n", by)).alias("i"))
    k, total = F.count(F.lit(1)), F.sum("n")
    gini = 2.0 * F.sum(F.col("i") * F.col("n")) / (k * total) - (k + 1) / k
    return placed.agg(k.alias("segments"), F.round(gini, 6).alias("gini"), F.round(F.max("n") / total, 6).alias("largest_share"))


def spread(found: DataFrame, numbers: tuple[str, ...], by: str = "segment") -> DataFrame:
    """Standard deviation of each feature within each group."""
    return found.groupBy(by).agg(*[F.round(F.stddev_samp(c), 6).alias(f"stddev_{c}") for c in numbers])


def centre_distances(found: DataFrame, numbers: tuple[str, ...], by: str = "segment") -> DataFrame:
    """Euclidean distance of every two groups' means. A row for each group is joined with those after it."""
    means = found.groupBy(by).agg(F.array(*[F.avg(c) for c in numbers]).alias("m"))
    a, b = means.select(F.col(by).alias("first"), F.col("m").alias("x")), means.select(F.col(by).alias("second"), F.col("m").alias("y"))
    gap = F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))
    pairs = a.join(F.broadcast(b), F.col("first") < F.col("second"))
    return pairs.select("first", "second", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)), 6).alias("distance"))


def centre_drift(before: DataFrame, now: DataFrame, numbers: tuple[str, ...], by: str = "segment") -> DataFrame:
    """How far each group's mean has moved."""
    means = lambda df, name: df.groupBy(by).agg(F.array(*[F.avg(c) for c in numbers]).alias(name))
    gap = F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))
    return means(before, "x").join(means(now, "y"), by).select(by, F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)), 6).alias("drift"))


def forecast_errors(rows: DataFrame, actual: str, predicted: str, size: str, small: int, large: int) -> DataFrame:
    """Root mean squared error and bias by cohort size (small, medium, large), with the share of forecasts on the right side of the mean."""
    every = Window.partitionBy(F.lit(0))  # a row for each cohort
    rows = rows.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("_mean", F.avg(actual).over(every))
    group = F.when(F.col(size) < small, "small").when(F.col(size) < large, "medium").otherwise("large")
    gap = F.col(predicted) - F.col(actual)
    right = (F.col(predicted) > F.col("_mean")) == (F.col(actual) > F.col("_mean"))
    base = F.sqrt(F.avg(F.pow(F.col("_mean") - F.col(actual), 2)))
    rmse = F.sqrt(F.avg(gap * gap))
    return rows.groupBy(group.alias("cohorts")).agg(
        F.count(F.lit(1)).alias("n"), F.round(rmse, 6).alias("rmse"), F.round(F.avg(gap), 6).alias("bias"),
        F.round(F.avg(right.cast("int")), 6).alias("directional_accuracy"), F.round(F.try_divide(base - rmse, base), 6).alias("gain_over_mean"),
    )


def feature_stats(rows: DataFrame, *numbers: str) -> DataFrame:
    """Mean and deviation of each feature of a run. One row."""
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("mean", F.avg), ("stddev", F.stddev_samp))])


def detection_rate(flagged: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Flagged over all rows of each group."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    hits = flagged.groupBy(by).agg(F.count(F.lit(1)).alias("flagged"))
    out = n.join(hits, by, "left").fillna(0, ["flagged"])
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("rows"), 6))


# --- tables of the scheduled models ------------------------------------------------------------------

# The tables' columns. Each row bears the day and the version of the model that made it.
TABLES = {
    "user_churn_scores": ("user_id", "churn_probability", "churn_predicted", "score_date", "model_version"),
    "user_segments": ("user_id", "segment_id", "segment_name", "segment_date", "model_version"),
    "segment_profiles": ("segment_id", "segment_name", "user_count", "avg_session_sec", "avg_actions", "avg_bounce_rate", "avg_lifetime_hours", "avg_lifetime_interactions", "avg_total_sessions", "profile_date"),
    "ml_performance_anomalies": ("app_version", "metric_date", "centroid_distance", "cluster_id", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms", "p99_distance_threshold", "detected_date", "model_version"),
    "device_ml_anomalies": ("device_type", "metric_date", "centroid_distance", "cluster_id", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms", "p99_distance_threshold", "detected_date", "model_version"),
    "cohort_retention_forecasts": ("cohort_week", "target_week", "predicted_retention", "model_type", "model_rmse", "forecast_date", "model_version"),
}
PERCENTILES = ("p50_duration_ms", "p95_duration_ms", "p99_duration_ms")


def churn_table(scores: DataFrame, day: str, version: str) -> DataFrame:
    named = scores.withColumnRenamed("predicted", "churn_predicted").withColumns({"score_date": F.lit(day).cast("date"), "model_version": F.lit(version)})
    return named.select(*TABLES["user_churn_scores"])


def segment_tables(found: DataFrame, sessions: DataFrame, day: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(user_segments, segment_profiles) of ``segments``' result. Segments are named by their rank in time spent."""
    hours = found.groupBy("segment").agg(F.avg("hours_spent").alias("h"))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("h"), "segment"))  # a row for each segment
    names = hours.select("segment", F.concat(F.lit("engagement "), order.cast("string")).alias("segment_name"))
    users = found.join(F.broadcast(names), "segment").withColumnRenamed("segment", "segment_id")
    own = sessions.groupBy("user_id").agg(F.avg(F.col("session_duration_ms") / 1000).alias("s"), F.avg("action_count").alias("a"), F.avg(F.col("is_bounce").cast("int")).alias("b"))
    per = users.join(own, "user_id", "left").groupBy("segment_id", "segment_name").agg(
        F.count(F.lit(1)).cast("int").alias("user_count"), F.avg("s").alias("avg_session_sec"), F.avg("a").alias("avg_actions"), F.avg("b").alias("avg_bounce_rate"),
        F.avg("hours_spent").alias("avg_lifetime_hours"), F.avg("total_interactions").alias("avg_lifetime_interactions"), F.avg("total_sessions").alias("avg_total_sessions"),
    )
    stamped = users.withColumns({"segment_date": F.lit(day).cast("date"), "model_version": F.lit(version)})
    return stamped.select(*TABLES["user_segments"]), per.withColumn("profile_date", F.lit(day).cast("date")).select(*TABLES["segment_profiles"])


def percentile_anomalies(perf: DataFrame, key: str, day: str, version: str, k: int = 3, percentile: float = 0.99) -> DataFrame:
    """Days of ``key`` (app_version or device_type) whose latency percentiles lie far from their cluster's centre."""
    rows = once(perf.select(key, "metric_date", *[F.col(c).cast("double").alias(c) for c in PERCENTILES]).dropna())
    prepared = Pipeline(stages=[VectorAssembler(inputCols=list(PERCENTILES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(rows).transform(rows)
    model = KMeans(k=k, seed=SEED).fit(prepared)
    out = _with_distance(model, prepared).withColumnsRenamed({"distance": "centroid_distance", "prediction": "cluster_id"})
    cut = out.agg(F.percentile_approx("centroid_distance", percentile, 10_000).alias("p99_distance_threshold"))  # one row
    flagged = out.crossJoin(F.broadcast(cut)).filter(F.col("centroid_distance") >= F.col("p99_distance_threshold"))
    flagged = flagged.withColumns({"detected_date": F.lit(day).cast("date"), "model_version": F.lit(version)})
    return flagged.select(*TABLES["ml_performance_anomalies" if key == "app_version" else "device_ml_anomalies"])


def forecast_table(forecasts: DataFrame, target_week: int, model_type: str, rmse: float, day: str, version: str) -> DataFrame:
    stamped = forecasts.withColumns({"target_week": F.lit(target_week), "predicted_retention": F.col("forecast"), "model_type": F.lit(model_type), "model_rmse": F.lit(float(rmse)), "forecast_date": F.lit(day).cast("date"), "model_version": F.lit(version)})
    return stamped.withColumn("cohort_week", F.col("cohort_week").cast("string")).select(*TABLES["cohort_retention_forecasts"])


def feature_drift(runs: DataFrame, value: str, days: int = 30, sigmas: float = 2.0) -> DataFrame:
    """Runs whose mean leaves ``sigmas`` deviations of the means of the ``days`` before. One row per run."""
    w = Window.orderBy(F.datediff("run_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    out = runs.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w)})
    return out.withColumn("drifted", F.coalesce(F.abs(F.col(value) - F.col("_m")) > sigmas * F.col("_s"), F.lit(False))).drop("_m", "_s")


def psi(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Population stability index over the values of a bucket column."""
    share = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, (F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0)))).alias(name))
    both = share(expected, "e").join(share(actual, "a"), key, "full").fillna(1e-6, ["e", "a"])
    return both.agg(F.round(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), 6).alias("psi"))
