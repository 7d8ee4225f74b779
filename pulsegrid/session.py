"""Spark sessions, tuning profiles and sizes."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import SparkSession

# Options of every session and of the kinds of jobs.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.memory.fraction": "0.8",
    "spark.memory.storageFraction": "0.3",
    "spark.sql.shuffle.partitions": "200",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.files.openCostInBytes": "4MB",
    "spark.sql.autoBroadcastJoinThreshold": "100MB",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.kryoserializer.buffer.max": "512m",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.join.preferSortMergeJoin": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}
#: environment variable: option, and its value where neither is given
ENVIRONMENT = {
    "SPARK_DRIVER_MEMORY": ("spark.driver.memory", "2g"),
    "SPARK_EXECUTOR_MEMORY": ("spark.executor.memory", "4g"),
    "SPARK_EXECUTOR_CORES": ("spark.executor.cores", "4"),
    "SPARK_WORKER_INSTANCE_COUNT": ("spark.executor.instances", "2"),
    "SPARK_SHUFFLE_PARTITIONS": ("spark.sql.shuffle.partitions", None),
    "SPARK_WAREHOUSE_DIR": ("spark.sql.warehouse.dir", None),
    "SPARK_CHECKPOINT_DIR": ("spark.checkpoint.dir", None),
}
PROFILES = {
    "etl": {"spark.sql.files.maxPartitionBytes": "128MB", "spark.sql.autoBroadcastJoinThreshold": "50MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB"},
    "analytics": {"spark.sql.files.maxPartitionBytes": "256MB", "spark.sql.autoBroadcastJoinThreshold": "200MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB"},
    "ml": {"spark.sql.files.maxPartitionBytes": "512MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512MB"},
    "streaming": {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "spark.sql.streaming.metricsEnabled": "true"},
}
#: MB of a shuffle partition by kind; kinds that are not here keep their number of partitions
PARTITION_MB = {"etl": 128, "analytics": 256, "ml": 512}
SUMMARY = (
    "spark.app.name", "spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.autoBroadcastJoinThreshold", "spark.executor.memory", "spark.executor.cores", "spark.driver.memory",
)


def create_session(app: str = "pulsegrid", master: str | None = None, hive: bool = False, log_level: str = "WARN", **conf: str) -> SparkSession:
    """``conf`` comes before the variables of ``ENVIRONMENT``, those before ``BASE``; ``SPARK_MASTER_URL`` is honoured too."""
    found = {key: os.environ.get(var) or default for var, (key, default) in ENVIRONMENT.items()}
    builder = SparkSession.builder.appName(app).config(map=BASE | {k: v for k, v in found.items() if v} | conf)
    if where := master or os.environ.get("SPARK_MASTER_URL"):
        builder = builder.master(where)
    spark = (builder.enableHiveSupport() if hive else builder).getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def config_summary(spark: SparkSession) -> dict[str, str]:
    return {k: spark.conf.get(k, None) or "not set" for k in SUMMARY}


def optimal_partitions(spark: SparkSession, data_size_gb: float = 1.0, partition_size_mb: int = 128, per_core: int = 2) -> int:
    """The largest of the cores, cores x ``per_core``, and the data over the partition size."""
    cores = max(2, spark.sparkContext.defaultParallelism)
    return max(cores, cores * per_core, math.ceil(data_size_gb * 1024 / partition_size_mb))


def configure_job(spark: SparkSession, kind: str, data_size_gb: float = 1.0) -> None:
    """Sets a profile's options; an unknown kind changes nothing."""
    if kind in PROFILES:
        for k, v in PROFILES[kind].items():
            spark.conf.set(k, v)
        if kind in PARTITION_MB:
            spark.conf.set("spark.sql.shuffle.partitions", str(optimal_partitions(spark, data_size_gb, PARTITION_MB[kind])))


def size_bytes(text: str) -> int:
    """``10485760``, ``50MB``, ``1g``, ``-1``: bytes."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * 1024 ** " kmgt".index(m[2] or " ")
