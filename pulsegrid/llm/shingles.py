"""Near copies by the similarity of their shingle sets, at 0.8 or more.

Candidates come from the multi-index SimHash tables, over fingerprints of five-word shingles, and, as 3 of 64 bits reach nearly equal
texts only, from bands: ``HASHES`` min-hashes of each text's distinct shingles, in bands of ``ROWS``. A pair of
similarity 0.8 shares one of the 40 keys with probability 0.9994. Every candidate is verified by the exact Jaccard similarity of the
whole shingle sets, in two steps.

1. Under each key every node is compared with the key's least node, its lead. A lead's nodes are dealt into slices, each with a copy
of the lead's text, and streamed, so that a group of any size is compared in linear time and no task holds it.
2. Where a key's nodes still belong to several verified groups, those outside the largest group are compared with each
other and with the largest group, which is dealt into slices too. The prefix filter used there loses no pair.

So every two texts that meet under a key end in one group if links of 0.8 or more connect them, and nothing below 0.8 is linked.

Defined results: null texts count as empty; texts without words are copies of each other; texts of up to five words are one shingle.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from pulsegrid.llm import simhash
from pulsegrid.llm.common import drop, fresh, stored
from pulsegrid.llm.components import components
from pulsegrid.llm.suffix import _mix

SIZE, HASHES, ROWS, SLICE = 5, 320, 8, 1024
ALIKE, OF = 4, 5  # the least similarity, 4/5, in whole numbers
_ODD = np.random.default_rng(11).integers(0, 1 << 31, (HASHES, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the text's shingles; a shorter text is one shingle."""
    w = (text or "").encode().lower().split()
    if len(w) <= size:
        return np.array([_hash(b" ".join(w))], np.uint64)
    return np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False))), np.uint64, len(w) - size + 1))


def bands(x: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    h = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 512):
        np.minimum(least, (h[lo : lo + 512] * _ODD).min(axis=1), out=least)
    rows = least.reshape(-1, ROWS).astype(np.uint64)
    k = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        k = _mix(k, rows[:, j])
    return k


def groups(sets: list[np.ndarray]) -> list[int]:
    """For each set the first member of its group, where sets of similarity 0.8 or more are linked."""
    m, sizes = len(sets), [len(x) for x in sets]
    value, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(value))  # rare shingles first
    several = np.empty(len(value), bool)
    several[rank] = count > 1
    tokens = np.split(rank[token], np.cumsum(sizes)[:-1])
    # two sets that are alike share one of the rarest n - ceil(0.8 n) + 1 shingles of either
    prefix, where = [], {}
    for i, t in enumerate(tokens):
        t.sort()
        p = t[: sizes[i] - -(-ALIKE * sizes[i] // OF) + 1]
        prefix.append(p[several[p]].tolist())
        for s in prefix[-1]:
            where.setdefault(s, []).append(i)
    label, mark = [-1] * m, np.zeros(len(value), bool)
    for start in range(m):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            x = todo.pop()
            near = set()
            for s in prefix[x]:
                where[s] = [y for y in where[s] if label[y] < 0]
                near.update(where[s])
            mark[tokens[x]] = True
            for y in near:
                both = int(np.count_nonzero(mark[tokens[y]]))
                if OF * both >= ALIKE * (sizes[x] + sizes[y] - both):
                    label[y] = start
                    todo.append(y)
            mark[tokens[x]] = False
    return label


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    if OF * min(len(x), len(y)) < ALIKE * max(len(x), len(y)):
        return False
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return OF * both >= ALIKE * (len(x) + len(y) - both)


def _node():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _with_keys(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ``node`` (a hash of the text), ``fp`` (a fingerprint of its distinct shingles) and ``bands``."""
    src = docs.select("doc_id", _node().alias("node"), "text")
    schema = StructType([*src.select("doc_id", "node").schema.fields]).add("fp", LongType()).add("bands", ArrayType(LongType()))

    def run(batches):
        for batch in batches:
            keys, fps = [], []
            for t in batch.column(2):
                x = shingles(t.as_py(), size)
                keys.append(bands(x))
                fps.append(simhash.majority(x))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (HASHES // ROWS)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=schema.names)

    return src.mapInArrow(run, schema)


def _under_bands(marked: DataFrame) -> DataFrame:
    """(lead, node): under each key every node and the key's least node."""
    rows = marked.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")

    def run(batches):
        last, lead = None, 0
        for batch in batches:
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            new = np.r_[last is None or key[0] != last, key[1:] != key[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at >= 0, node[at], lead)
            last, lead = key[-1], first[-1]
            keep = first != node
            pair = np.unique(np.stack([first[keep], node[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["lead", "node"])

    return rows.mapInArrow(run, "lead long, node long")


def _under_fingerprints(marked: DataFrame) -> DataFrame:
    """(lead, node) from SimHash: nodes with the first of their fingerprint, and the firsts of linked fingerprints."""
    values = stored(marked.groupBy("fp").agg(F.min("node").alias("lead"), F.max("node").alias("most")), "shingle-fps")
    same = marked.join(values.filter("lead < most").select("fp", "lead"), "fp").select("lead", "node").filter("lead <> node")
    near = simhash.links(values.select("fp", F.lit(0).alias("tag")))
    for end in ("a", "b"):
        near = near.join(values.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_node")), end)
    return same.unionByName(near.select(F.least("a_node", "b_node").alias("lead"), F.greatest("a_node", "b_node").alias("node")))


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The (lead, node) of ``pairs`` that are similar."""
    n = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    slices = F.expr(f"n div {SLICE} + 1")
    nodes = pairs.join(n, "lead").join(texts, "node").select("lead", F.pmod(F.xxhash64("node"), slices).alias("slice"), F.lit(1).alias("side"), "node", "text")
    leads = n.join(texts, n["lead"] == texts["node"]).select("lead", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), F.lit(0).alias("side"), "node", "text")
    rows = leads.unionByName(nodes).repartition("lead", "slice").sortWithinPartitions("lead", "slice", "side").select("lead", "side", "node", "text")

    def run(batches):
        own = None
        for batch in batches:
            a, b = [], []
            for lead, side, node, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = shingles(text, size)
                if not side:
                    own = x
                elif similar(own, x):
                    a.append(lead)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["lead", "node"])

    return rows.mapInArrow(run, "lead long, node long")


def _across(marked: DataFrame, pairs: DataFrame, found: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between the verified groups ``found`` (node, component) that meet under a key."""
    met = pairs.select(F.explode(F.array("lead", "node")).alias("node")).distinct()
    keyed = marked.join(met, "node", "left_semi").select("node", "bands").dropDuplicates(["node"]).join(found, "node", "left")
    keyed = keyed.select(F.explode("bands").alias("key"), "node", F.coalesce("component", "node").alias("component"))
    per = keyed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("sign"))
    mixed = per.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("nodes"), F.sum("sign").alias("sign")).filter("groups > 1")
    # keys of the same nodes are worked on once
    mixed = stored(mixed.groupBy("sign", "nodes").agg(F.min(F.struct("key", "most")).alias("x")).select("x.key", "x.most"), "shingle-mixed")
    slices = F.expr(f"most.n div {SLICE} + 1")
    rows = keyed.join(mixed, "key")
    outside = F.col("component") != F.col("most")["component"]
    to = F.when(outside, F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), slices)))
    rows = rows.select("key", F.explode(to).alias("slice"), "node").join(texts, "node").select("key", "slice", "node", "text")
    rows = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "node")

    def run(batches):
        current, nodes, sets = None, [], []

        def emit():
            pair = [(nodes[i], n) for i, n in zip(groups(sets), nodes, strict=True) if nodes[i] != n]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pair], pa.int64()), pa.array([p[1] for p in pair], pa.int64())], names=["lead", "node"])

        for batch in batches:
            for key, part, node, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, part) != current and nodes:
                    yield emit()
                    nodes, sets = [], []
                current = key, part
                nodes.append(node)
                sets.append(shingles(text, size))
        if nodes:
            yield emit()

    return rows.mapInArrow(run, "lead long, node long")


def near_copies(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, node (a hash of the text) and group (the same for texts that links connect)."""
    marked = stored(_with_keys(docs, size), "shingle-keys")
    pairs = stored(_under_bands(marked).unionByName(_under_fingerprints(marked)).distinct(), "shingle-pairs")
    met = pairs.select(F.explode(F.array("lead", "node")).alias("node")).distinct()
    texts = docs.select(_node().alias("node"), "text").join(met, "node", "left_semi")
    texts = stored(texts.groupBy("node").agg(F.any_value("text").alias("text")), "shingle-texts")
    links = stored(_compared(pairs, texts, size), "shingle-links")
    more = _across(marked, pairs, components(links, "lead", "node"), texts, size)
    found = components(links.unionByName(more), "lead", "node")
    drop(pairs, texts, links)
    return marked.select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("group"))


def one_of_each(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of each group of ``near_copies``: that with the least doc_id (null last, then by a hash of the text); of rows that repeat it, that with the least hash of all columns."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = near_copies(docs, size).groupBy("group").agg(F.min(order).alias("x")).select("x.doc_id", "x.node")
    node, row = fresh(docs, "node"), fresh(docs, "row")
    rows = docs.withColumn(node, _node())
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[node] == kept["node"]), "left_semi")
    rows = rows.groupBy("doc_id", node).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return rows.select(*[F.col(row)[c].alias(c) for c in docs.columns])
