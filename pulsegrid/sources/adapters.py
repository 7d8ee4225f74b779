"""The driver's tables as interactions and users."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEVICES = ("iPhone", "iPad", "Android Phone", "Android Tablet")


def one_machine(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's process."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder; on one machine without one, a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_interactions(table(spark, sf_dir, "events"))


def as_interactions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action_type"),
        F.concat(F.lit("p"), k).alias("page_id"),
        F.round(F.col("value") * 1000).cast("int").alias("duration_ms"),
        F.concat(F.lit("3."), (k.cast("int") % 5).cast("string"), F.lit(".0")).alias("app_version"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows by definition
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.element_at(F.array(*map(F.lit, DEVICES)), (F.col("c_custkey") % 4).cast("int") + 1).alias("device_type"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("subscription_type"),
        F.date_add(F.lit("2023-12-04").cast("date"), (F.col("c_custkey") % 42).cast("int")).alias("registration_date"),
    )


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderstatus").alias("action_type"),
        F.col("o_orderpriority").alias("page_id"),
        F.round("o_totalprice").cast("int").alias("duration_ms"),
    )


def order_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered on the day of the first order."""
    return order_interactions(spark, sf_dir).groupBy("user_id").agg(F.min(F.to_date("timestamp")).alias("registration_date"))
