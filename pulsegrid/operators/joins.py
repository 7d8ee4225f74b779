"""Hot keys, salting and a join that chooses between them and a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import once
from pulsegrid.schema import need
from pulsegrid.session import size_bytes


def hot_keys(df: DataFrame, key: str, percentile: float = 0.99) -> DataFrame:
    """(key, count) of the keys whose count is strictly above that percentile of the keys' counts.

    Counts are taken once, where the session has a checkpoint folder; else the plan reads ``df`` for the counts and for the percentile.
    """
    need(df, key)
    counts = once(df.groupBy(key).agg(F.count(F.lit(1)).alias("count")))
    cut = counts.agg(F.percentile_approx("count", percentile, 10_000).alias("_cut"))  # one row
    return counts.crossJoin(F.broadcast(cut)).filter(F.col("count") > F.col("_cut")).drop("_cut")


def _check(df: DataFrame, key: str, factor: int) -> None:
    need(df, key)
    if factor < 2:
        raise ValueError("a salt factor is at least 2")


def _marked(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    # a left join that Spark is free to broadcast by its own size estimate: hot keys are few, but not by proof
    return df.join(hot.select(key).distinct().withColumn("_hot", F.lit(True)), key, "left")


def apply_salting(df: DataFrame, hot: DataFrame, key: str, factor: int = 10) -> DataFrame:
    """Adds ``salt`` (hot keys: by the row's hash, which a retried task repeats; others: 0) and ``<key>_salted``."""
    _check(df, key, factor)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*df.columns), F.lit(factor))).otherwise(0).cast("int")
    out = _marked(df, hot, key).withColumn("salt", salt).drop("_hot")
    return out.withColumn(f"{key}_salted", F.concat(F.col(key).cast("string"), F.lit("_"), F.col("salt").cast("string"))).select(*df.columns, "salt", f"{key}_salted")


def explode_for_salting(df: DataFrame, hot: DataFrame, key: str, factor: int = 10) -> DataFrame:
    """Rows of hot keys once for every salt, others with salt 0."""
    _check(df, key, factor)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(factor - 1))).otherwise(F.array(F.lit(0)))
    out = _marked(df, hot, key).withColumn("salt", F.explode(salts)).drop("_hot")
    return out.withColumn(f"{key}_salted", F.concat(F.col(key).cast("string"), F.lit("_"), F.col("salt").cast("string"))).select(*df.columns, "salt", f"{key}_salted")


def salted_join(large: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "inner", factor: int = 10) -> DataFrame:
    """Joins with the hot keys spread over ``factor`` partitions. Inner and left only: elsewhere a small row would come out once per salt, so the plain join is used."""
    if how not in ("inner", "left", "left_outer", "leftouter"):
        return large.join(small, key, how)
    hot = once(hot.select(key).distinct())  # both sides are marked by it
    a, b = apply_salting(large, hot, key, factor), explode_for_salting(small, hot, key, factor)
    out = a.join(b.drop(key, "salt"), f"{key}_salted", how).drop("salt", f"{key}_salted")
    return out.select(*large.columns, *[c for c in small.columns if c != key])


def optimized_join(
    large: DataFrame, small: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None,
    enable_broadcast: bool = True, enable_salting: bool = True, skew_percentile: float = 0.99, factor: int = 10, row_bytes: int = 100,
) -> DataFrame:
    """Given hot keys: salted. Else broadcast, if counting finds the small side within Spark's broadcast threshold. Else salted on the keys found hot."""
    need(large, key)
    need(small, key)
    if hot is not None and enable_salting:
        return salted_join(large, small, key, hot, how, factor)
    if enable_broadcast and how in ("inner", "left", "left_outer", "leftouter"):
        limit = size_bytes(large.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        most = max(0, limit) // row_bytes
        if most and small.limit(most + 1).count() <= most:
            return large.join(F.broadcast(small), key, how)
    if enable_salting:
        return salted_join(large, small, key, hot_keys(large, key, skew_percentile), how, factor)
    return large.join(small, key, how)


def enrich(interactions: DataFrame, metadata: DataFrame, **how) -> DataFrame:
    """Every interaction with its user's metadata and the day it belongs to."""
    return optimized_join(interactions, metadata, "user_id", "left", **how).withColumn("date", F.to_date("timestamp"))
