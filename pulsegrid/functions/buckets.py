"""Display buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits in ms with their labels, and the label beyond them.
DURATIONS = ((60_000, "< 1 min"), (300_000, "1-5 min"), (900_000, "5-15 min"), (1_800_000, "15-30 min"))
LONGEST = "> 30 min"
ACTIONS = ((1, "1 action (Bounce)"), (3, "2-3 actions"), (10, "4-10 actions"))
MOST = "> 10 actions"


def duration_bucket(ms: Column) -> Column:
    out = F.when(ms < DURATIONS[0][0], DURATIONS[0][1])
    for limit, label in DURATIONS[1:]:
        out = out.when(ms < limit, label)
    return out.otherwise(LONGEST)


def action_bucket(n: Column) -> Column:
    out = F.when(n <= ACTIONS[0][0], ACTIONS[0][1])
    for limit, label in ACTIONS[1:]:
        out = out.when(n <= limit, label)
    return out.otherwise(MOST)


def effect_size(eta_squared: Column) -> Column:
    return F.when(eta_squared < 0.01, "negligible").when(eta_squared < 0.06, "small").when(eta_squared < 0.14, "medium").otherwise("large")


def share(n: Column, total: Column) -> Column:
    return F.round(F.try_divide(n * 100.0, total), 2)
