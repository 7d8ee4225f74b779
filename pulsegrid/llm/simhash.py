"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are majority votes over the XXH64 values of 3-word shingles (repeats
included). Two fingerprints within ``radius`` 3 have one of their two 32-bit halves within 1 bit. Each half
of each distinct fingerprint is entered in a table under its value, and probes the table with a Hamming ball
of radius 1 around it (each pair needs one flip only, so a fingerprint flips its zero bits). Rows that meet under a key are verified on
all 64 bits; a key gives a spanning forest of its links, never all pairs, so a
large group of near copies costs rows in proportion to its size. Components of the links are then labelled.

Defined results: null texts count as empty; texts without words have fingerprint 0 and link like any
other; repeated rows are rows of their own; null doc_ids keep their rows and never name a component unless
alone.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from pulsegrid.llm.common import stored
from pulsegrid.llm.components import components

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bytes are summed 255 rows at a time."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return sum((bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)), np.zeros(64, np.int64))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    return int(np.packbits(2 * _votes(h) > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = w[lo : lo + (1 << 16) + size - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(size)], strict=False)) if len(w) > size else [b" ".join(w)]
        votes += _votes(np.fromiter(map(_hash, shingles), np.uint64))
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    src = docs.select("doc_id", "text")
    schema = StructType([*docs.select("doc_id").schema.fields]).add("fp", LongType())

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the links (distance at most ``radius``) among distinct fingerprints."""
    out = []
    if len(fps) > 2048 and radius < 4:  # two that differ in 3 bits agree in one of any 4 bytes
        for k in range(4):
            byte = (fps >> np.uint64(16 * k)).astype(np.uint8)
            order = np.argsort(byte, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                if len(part) > 1:
                    out += _spread(fps[part], radius)
        return out
    return _spread(fps, radius)


def _spread(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search; each fingerprint is compared with those not yet reached."""
    out, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                todo.extend(found)
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(tag, a, b): spanning links among the distinct fingerprints ``fp`` of each ``tag`` (an int below 2**30), each verified."""
    if radius != 3:
        raise ValueError("two halves and a ball of radius 1 serve distance 3")

    def keys(shift: int):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
        bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(F.lit(1)) == 0)
        tag = F.lit(shift << 27).cast("long").bitwiseOR(F.shiftleft(F.col("tag").cast("long"), 33))  # bit 32: which half
        own = F.array(F.struct(value.bitwiseOR(tag).alias("key"), F.lit(True).alias("own")))
        ball = F.transform(bits, lambda i: F.struct(value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseOR(tag).alias("key"), F.lit(False).alias("own")))
        return F.concat(own, ball)

    rows = fps.select("fp", "tag", F.inline(F.concat(keys(0), keys(32)))).select("key", "own", "fp")
    rows = rows.repartition("key").sortWithinPartitions("key")

    def run(batches):
        kept: list[np.ndarray] = []
        empty = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]

        def emit(key, own, fp):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(key)])
            some = np.add.reduceat(own, starts) > 0 if len(key) else np.zeros(0, bool)
            a, b, tags = [], [], []
            for s, n in zip(starts[some & (sizes > 1)], sizes[some & (sizes > 1)], strict=True):
                if n == 2:
                    if (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= radius:
                        a.append(fp[s : s + 1])
                        b.append(fp[s + 1 : s + 2])
                        tags.append(key[s : s + 1] >> 33)
                    continue
                for x, y in _forest(fp[s : s + n], radius):
                    a.append(x)
                    b.append(y)
                    tags.append(np.full(len(x), key[s] >> 33))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tags).astype(np.int32)), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["tag", "a", "b"])

        kept = empty
        for batch in batches:
            key = np.asarray(batch.column(0))
            own = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            fp = np.asarray(batch.column(2)).view(np.uint64)
            key, own, fp = (np.concatenate([k, x]) for k, x in zip(kept, (key, own, fp), strict=True))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            yield from emit(key[:cut], own[:cut], fp[:cut])
            kept = [key[cut:], own[cut:], fp[cut:]]
        yield from emit(*kept)

    return rows.mapInArrow(run, "tag int, a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach, itself included)."""
    marked = stored(with_fingerprints(docs, size), "simhash-fp")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    comp = components(links(nodes.withColumn("tag", F.lit(0))))
    nodes = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    per = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(per, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
