import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pulsegrid.operators import checks, joins
from pulsegrid.session import size_bytes


def skewed(spark):
    hot = spark.range(10_000).select(F.lit("u000").alias("user_id"), F.col("id").cast("int").alias("n"))
    return hot.unionByName(spark.range(9_900).select(F.format_string("u%03d", F.col("id") % 99 + 1).alias("user_id"), F.col("id").cast("int").alias("n")))


def test_hot_keys(spark):
    assert [(r.user_id, r["count"]) for r in joins.hot_keys(skewed(spark), "user_id").collect()] == [("u000", 10_000)]
    even = spark.range(100).select((F.col("id") % 10).cast("string").alias("user_id"))
    assert joins.hot_keys(even, "user_id").count() == 0
    assert joins.hot_keys(even.limit(0), "user_id").count() == 0
    with pytest.raises(ValueError):
        joins.hot_keys(even, "nope")


def test_salt_spreads_evenly_and_repeats(spark):
    df = skewed(spark)
    hot = spark.createDataFrame([("u000", 10_000)], "user_id string, count long")
    salted = joins.apply_salting(df, hot, "user_id", 10)
    counts = [r.n for r in salted.filter("user_id = 'u000'").groupBy("salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 10 and all(800 <= n <= 1200 for n in counts)
    assert salted.filter("user_id <> 'u000' AND salt <> 0").count() == 0
    assert salted.exceptAll(joins.apply_salting(df, hot, "user_id", 10)).count() == 0
    with pytest.raises(ValueError):
        joins.apply_salting(df, hot, "user_id", 1)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_salted_join_equals_plain_join(spark, how):
    df = skewed(spark).unionByName(spark.createDataFrame([("none", 1)], "user_id string, n int"))
    small = spark.createDataFrame([("u000", "x"), ("u001", "y"), ("extra", "z")], "user_id string, country string")
    got = joins.salted_join(df, small, "user_id", joins.hot_keys(df, "user_id"), how)
    want = df.join(small, "user_id", how)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_optimized_join_paths(spark):
    df = skewed(spark)
    small = spark.createDataFrame([(f"u{i:03d}", "x") for i in range(50)], "user_id string, country string")
    for how in ({}, {"enable_broadcast": False}, {"enable_broadcast": False, "enable_salting": False}, {"hot": joins.hot_keys(df, "user_id")}):
        assert joins.optimized_join(df, small, "user_id", **how).count() == 19_900
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50MB")
    try:
        assert joins.optimized_join(df, small, "user_id").count() == 19_900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sizes():
    assert [size_bytes(x) for x in ("10485760", "50MB", "1g", "-1", "8kb")] == [10_485_760, 50 << 20, 1 << 30, -1, 8192]
    with pytest.raises(ValueError):
        size_bytes("many")


def test_null_columns_in_order(spark):
    df = spark.createDataFrame([("a", 1, None), (None, None, "x"), ("b", 2, "y")], "user_id string, n int, s string")
    out = checks.detect_nulls(df, ["n", "user_id", "s"]).collect()
    assert sorted(r.null_columns for r in out) == [["n", "user_id"], ["s"]]
    none = checks.detect_nulls(df, [])
    assert none.count() == 0 and dict(none.dtypes)["null_columns"] == "array<string>"
    with pytest.raises(ValueError):
        checks.detect_nulls(df, ["nope"])


def test_outliers(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 101)] + [(101, -100), (102, 200)], "id int, value int")
    out = {r.value: r.outlier_reason for r in checks.detect_outliers(df, "value").collect()}
    assert out == {-100: "iqr_outlier_below", 200: "iqr_outlier_above"}
    limits = checks.detect_outliers(df, "value", "threshold", min_value=0, max_value=150).collect()
    assert {(r.value, r.outlier_reason, r.outlier_value) for r in limits} == {(-100, "below_min", -100.0), (200, "above_max", 200.0)}
    assert checks.detect_outliers(df, "value", "threshold").count() == 0
    assert checks.detect_outliers(df.limit(0), "value").count() == 0
    for bad in ({"method": "x"}, {"iqr_multiplier": 0}):
        with pytest.raises(ValueError):
            checks.detect_outliers(df, "value", **bad)
    with pytest.raises(ValueError):
        checks.detect_outliers(df.withColumn("s", F.lit("a")), "s")


def test_schema_checks(spark):
    df = spark.createDataFrame([("a", 1)], "user_id string, n long")
    want = StructType([StructField("user_id", StringType()), StructField("n", IntegerType()), StructField("m", IntegerType())])
    ok, errors = checks.validate_schema(df, want)
    assert not ok and len(errors) == 2
    assert checks.validate_schema(df, df.schema) == (True, [])
    with pytest.raises(ValueError):
        checks.validate_schema(df, None)
    with pytest.raises(ValueError):
        checks.validate(df)
    with pytest.raises(ValueError):
        checks.validate(df, ["m"])
    assert checks.validate(df, ["n"], ["user_id"]) == []
