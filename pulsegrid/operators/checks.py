"""Data quality: schema, nulls and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from pulsegrid.schema import need


def validate_schema(df: DataFrame, expected: StructType, strict: bool = True) -> tuple[bool, list[str]]:
    """(ok, errors): missing columns, differing types, and, if strict, further columns. Order and nullability are free."""
    if df is None or expected is None:
        raise ValueError("a frame and a schema are needed")
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    errors = [f"missing column: {c}" for c in want if c not in have]
    errors += [f"{c} is {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    errors += [f"unexpected column: {c}" for c in have if strict and c not in want]
    return not errors, errors


def validate(df: DataFrame, required: list[str] | None = None, not_null: list[str] | None = None, schema: StructType | None = None) -> list[str]:
    """Raises for missing columns or if nothing is to be checked; returns warnings on types and nulls (one aggregation)."""
    if not (required or not_null or schema):
        raise ValueError("nothing to validate")
    need(df, *(required or []))
    warnings = []
    if schema is not None:
        warnings += validate_schema(df, schema, strict=False)[1]
    if cols := [c for c in not_null or [] if c in df.columns]:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).head()
        warnings += [f"{c} has {counts[c]} nulls" for c in cols if counts[c]]
    return warnings


def detect_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the columns, and ``null_columns`` in the order asked for."""
    need(df, *columns)
    named = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns]
    if not columns:
        return df.withColumn("null_columns", F.array().cast("array<string>")).filter(F.lit(False))
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).withColumn("null_columns", F.array_compact(F.array(*named)))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """For each numeric column count, mean, stddev, min and max as doubles: a row per column, from one aggregation."""
    need(df, *columns)
    parts = (("count", F.count), ("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))
    wide = df.agg(*[F.struct(*[f(c).cast("double").alias(n) for n, f in parts]).alias(c) for c in columns])  # one row
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(c)[n].alias(n) for n, _ in parts]) for c in columns])))


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", iqr_multiplier: float = 1.5, min_value: float | None = None, max_value: float | None = None, accuracy: int = 1_000_000) -> DataFrame:
    """Rows outside the quartiles by ``iqr_multiplier`` ranges, or outside given limits, with ``outlier_reason`` and ``outlier_value``."""
    need(df, column)
    if not isinstance(df.schema[column].dataType, NumericType):
        raise ValueError(f"{column} is not numeric")
    value = F.col(column).cast("double")
    if method == "iqr":
        if iqr_multiplier <= 0:
            raise ValueError("the multiplier must be positive")
        q = df.agg(F.percentile_approx(value, [0.25, 0.75], accuracy).alias("_q"))  # one row
        lo = F.col("_q")[0] - iqr_multiplier * (F.col("_q")[1] - F.col("_q")[0])
        hi = F.col("_q")[1] + iqr_multiplier * (F.col("_q")[1] - F.col("_q")[0])
        reason = F.when(value < lo, "iqr_outlier_below").when(value > hi, "iqr_outlier_above")
        out = df.crossJoin(F.broadcast(q)).withColumn("outlier_reason", reason).drop("_q")
    elif method == "threshold":
        below = F.lit(False) if min_value is None else value < min_value
        above = F.lit(False) if max_value is None else value > max_value
        out = df.withColumn("outlier_reason", F.when(below, "below_min").when(above, "above_max"))
    else:
        raise ValueError(f"unknown method: {method}")
    return out.filter("outlier_reason IS NOT NULL").withColumn("outlier_value", value)
