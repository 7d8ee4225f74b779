"""Counts on the side of a job: observed metrics, row checks, partition skew and a summary."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Sum(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return a + b


class Errors(AccumulatorParam):
    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}


class Spread(AccumulatorParam):
    """Largest and smallest partition and their number."""

    def zero(self, value):
        return {"max": 0, "min": None, "count": 0}

    def addInPlace(self, a, b):
        if isinstance(b, int):
            b = {"max": b, "min": b, "count": 1}
        lows = [x["min"] for x in (a, b) if x["min"] is not None]
        return {"max": max(a["max"], b["max"]), "min": min(lows, default=None), "count": a["count"] + b["count"]}


@dataclass
class Context:
    job: str
    records: object
    skipped: object
    errors: object
    partitions: object
    notes: list[str] = field(default_factory=list)


def context(sc: SparkContext, job: str) -> Context:
    """Accumulators count again what a retried task counts; ``observed`` is exact for a successful action."""
    return Context(job, sc.accumulator(0, Sum()), sc.accumulator(0, Sum()), sc.accumulator({}, Errors()), sc.accumulator({"max": 0, "min": None, "count": 0}, Spread()))


def observed(df: DataFrame, not_null: Iterable[str] = (), numeric: Iterable[str] = ()) -> tuple[DataFrame, Observation]:
    """The frame, and an observation of its rows, nulls and negative values that fills when an action runs."""
    seen = Observation()
    checks = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null] + [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in numeric]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *checks), seen


def partition_sizes(df: DataFrame) -> DataFrame:
    """max, min and number of partitions by rows."""
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("n").alias("max_rows"), F.min("n").alias("min_rows"), F.count(F.lit(1)).alias("partitions"))


def track_errors(row: dict, ctx: Context, not_null: Iterable[str], numeric: Iterable[str]) -> bool:
    """Counts nulls and negative values of one row; True if it has none."""
    found = {f"null_{c}": 1 for c in not_null if row.get(c) is None}
    found |= {f"negative_{c}": 1 for c in numeric if isinstance(row.get(c), int | float) and row[c] < 0}
    if found:
        ctx.errors.add(found)
    return not found


def track_partition(rows: Iterable, ctx: Context) -> Iterator:
    n = 0
    for row in rows:
        n += 1
        yield row
    ctx.partitions.add({"max": n, "min": n, "count": 1})


# What each profile tracks, and the skew from which a summary warns.
_TRACK = ("track_records", "track_skipped", "track_dq_errors", "track_partition_skew", "fail_on_errors")
PROFILES = {
    "strict": dict(zip(_TRACK, (True, True, True, True, True), strict=True)) | {"skew_threshold": 3.0},
    "standard": dict(zip(_TRACK, (True, True, True, True, False), strict=True)) | {"skew_threshold": 5.0},
    "minimal": dict(zip(_TRACK, (True, False, False, False, False), strict=True)) | {"skew_threshold": 10.0},
}


class QualityError(ValueError):
    """Raised under a profile that fails on errors."""


def record(ctx: Context, seen: Observation, how: dict) -> None:
    """Adds what an observation of ``observed`` has seen, as far as the profile tracks it. An action must have run."""
    found = seen.get
    errors = {k: v for k, v in found.items() if k != "rows" and v}
    if how["track_records"]:
        ctx.records.add(found["rows"])
    if how["track_dq_errors"] and errors:
        ctx.errors.add(errors)
    if how["fail_on_errors"] and errors:
        raise QualityError(", ".join(f"{k}: {v}" for k, v in sorted(errors.items())))


def profile(name: str) -> dict:
    return dict(PROFILES.get(name, PROFILES["standard"]))


def summary(ctx: Context, skew_threshold: float = 3.0) -> str:
    done, skipped = ctx.records.value, ctx.skipped.value
    total = done + skipped
    lines = [f"job {ctx.job}", f"records {done}", f"skipped {skipped} ({100 * skipped / total if total else 0:.2f} %)"]
    for name, n in sorted(ctx.errors.value.items(), key=lambda x: (-x[1], x[0])):
        lines.append(f"  {name}: {n} ({100 * n / total if total else 0:.2f} %)")
    p = ctx.partitions.value
    if p["count"]:
        ratio = p["max"] / p["min"] if p["min"] else float("inf")
        lines.append(f"partitions {p['count']}, rows {p['min']} to {p['max']}, skew {ratio:.2f}" + (f" - above {skew_threshold:g}, consider salting" if ratio > skew_threshold else ""))
    return "\n".join(lines)


def with_monitoring(job: str) -> Callable:
    """A decorator for functions whose first argument is a session: passes ``ctx`` and logs the summary."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark, *args, **kwargs):
            ctx = context(spark.sparkContext, job)
            try:
                return f(spark, *args, ctx=ctx, **kwargs)
            finally:
                log.info(summary(ctx))

        return run

    return wrap
