"""Frames that are used several times, and exact ranks without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

CUTS = 64


def once(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, where the session has one, so that what is used several times is computed once; else ``df``."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def ranked(df: DataFrame, value: str, tie: str, cuts: int = CUTS, points: list | None = None) -> DataFrame:
    """Adds ``_rank`` (1 for the largest value, ties by ``tie``) and ``_n`` (rows).

    Approximate quantiles deal rows into ranges; the exact rank is the number of rows in the ranges above plus the place within the
    range, so that only a range is sorted in one task. Null values come last. ``points``: quantiles that are known already.

    The quantiles are taken in the driver: another evaluation may give others, and the ranges of rows and of sizes must be the same.
    """
    if points is None:
        points = df.agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10_000)).head()[0] or []
    known = F.array(*map(F.lit, points)).cast(ArrayType(df.schema[value].dataType))
    above = F.when(F.col(value).isNull(), len(points) + 1).otherwise(F.size(F.filter(known, lambda p: p > F.col(value))))
    rows = df.withColumn("_range", above)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    among = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = F.coalesce(F.sum("_size").over(among.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc_nulls_last(value), tie))
    return rows.join(F.broadcast(sizes), "_range").withColumn("_rank", F.col("_before") + place).drop("_range", "_before")
