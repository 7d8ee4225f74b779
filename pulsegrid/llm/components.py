"""Connected components by randomised contraction, all in joins and aggregates.

In each round every node picks, among itself and its neighbours, the one with the least hash for that
round, and edges are mapped to the picks; a constant share of the nodes goes away each round whatever the shape of the
graph, chains and stars included. Each round's picks and remaining edges are stored, so no lineage
grows; at the end the picks are composed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the least node of its component."""
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pair = stored(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = pair.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = stored(nodes.withColumn("label", F.col("node")), "cc-labels")
    turn = 0
    while not pair.isEmpty():
        turn += 1
        # a node with a great many neighbours is no single task: its neighbours' least hash is found in part first
        each = F.inline(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("near")) for x, y in ("ab", "ba", "aa", "bb")]))
        pick = stored(pair.select(each).groupBy("node").agg(F.min_by("near", F.xxhash64("near", F.lit(turn))).alias("pick")), "cc-picks")
        moved = pair.join(pick.select(F.col("node").alias("a"), F.col("pick").alias("p")), "a").join(pick.select(F.col("node").alias("b"), F.col("pick").alias("q")), "b")
        left = stored(moved.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "cc-edges")
        step = pick.select(F.col("node").alias("label"), "pick")
        named = stored(label.join(step, "label", "left").select("node", F.coalesce("pick", "label").alias("label")), "cc-labels")
        drop(pair, pick, label)
        pair, label = left, named
    least = label.groupBy("label").agg(F.min("node").alias("component"))
    return label.join(least, "label").select("node", "component")
