"""Exact substring dedup by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes (200) that also starts anywhere else is removed. Suffixes
are put into buckets by their first 64 bytes, and buckets are refined by the bucket identifiers of later offsets: 128
bytes by those at 0 and 64, 200 bytes by those at 0 and 72 of the 128-byte buckets; each level's identifiers are made
once and reused by the next. Identifiers are 64-bit content hashes, not dense ranks, so that refinement needs no global sort;
a decision rests on 96 bits or more.

Not all suffixes take part: of each 200-byte window only its anchor, the 64-byte gram with the least hash (leftmost among
equals), which equal windows share at the same place. An anchor serves a stretch of windows, its context.
Buckets of one anchor are settled and never refined. Contexts that occur twice are removed whole. Only where an anchor
has differing contexts are its windows refined to 200 bytes, one by one.

Texts move once, into blocks; what blocks exchange with buckets are distinct keys, at most one per key and block (two for anchors), so
a passage that a third of all documents share costs a bucket no more than the number of blocks.

Defined results: null texts count as empty; texts shorter than ``length`` are kept; repeated rows are copies of each other;
null doc_ids are ordinary rows. In ``deduped`` a character that a cut splits is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from pulsegrid.llm.common import block_count, dealt, fresh, spared

LENGTH, GRAM, BLOCK_BYTES = 200, 64, 4_000_000
#: Windows that are worked on together; a place within a piece has 20 bits.
PIECE, _LOW = 1 << 19, np.uint64((1 << 20) - 1)
_SEED = np.full(1, 0x5851F42D4C957F2D, np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd constants of the mixing function
PART = "kind int, bucket int, block int, n int, data binary"
#: kinds of rows that travel: what a block asks of a bucket, what a bucket answers, and spans a block knows for itself
CONTEXT, ANCHOR, WINDOW, SPANS = 1, 2, 3, 4


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = a * _K1
    r += b
    r ^= r >> np.uint64(31)
    r *= _K2
    r ^= r >> np.uint64(29)
    return r


def _words(t: np.ndarray) -> np.ndarray:
    """A view of the eight bytes at every position."""
    return np.ndarray((max(0, len(t) - 7),), "<u8", t, strides=(1,))


def _level(g: np.ndarray, size: int) -> np.ndarray:
    """Identifiers of strings of twice ``size`` bytes from those of ``size`` at an offset and ``size`` further on."""
    return _mix(g[:-size], g[size:])


def _grams(t: np.ndarray) -> np.ndarray:
    """The identifiers of the 64-byte strings at every position, refined from those of 8, 16 and 32 bytes."""
    g = _mix(np.array(_words(t)), _SEED)
    for size in (8, 16, 32):
        g = _level(g, size)
    return g


def _grams_at(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same identifiers at the places ``at`` only."""
    w = _words(t)
    g = [_mix(w[at + 8 * k], _SEED) for k in range(GRAM // 8)]
    while len(g) > 1:
        g = [_mix(x, y) for x, y in zip(g[::2], g[1::2], strict=True)]
    return g[0]


class Block:
    """The documents of a block in a fixed order, their bytes end to end, and the anchors of their windows."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").to_pylist()
        raw = [(x or "").encode() for x in table.column("text").to_pylist()]
        self.order = sorted(range(len(raw)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i]))
        self.raw = [raw[i] for i in self.order]
        self.ends = np.cumsum([len(x) for x in self.raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(x) for x in self.raw], np.int64) if self.raw else self.ends
        self.length = length

    def anchors(self) -> None:
        """a, b: first and last window of each anchor; gram: the anchor's identifier; context: its context's.

        Works on pieces of ``PIECE`` bytes, so that what it holds beside the text follows the number of anchors.
        """
        self.t = t = np.frombuffer(b"".join(self.raw), np.uint8)
        n, w = len(t), self.length - GRAM + 1
        none = np.zeros(0, np.int64)
        self.a = self.b = none
        self.gram = self.context = none.astype(np.uint64)
        last = n - self.length + 1  # windows start before
        if last < 1:
            return
        long = self.ends - self.starts >= self.length
        step = np.zeros(n + 1, np.int8)  # +1 where a document's windows begin, -1 where they end
        step[self.starts[long]] = 1
        step[self.ends[long] - self.length + 1] = -1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inside = 0
        for lo in range(0, last, PIECE):
            hi = min(lo + PIECE, last)
            g = _grams(t[lo : hi + self.length - 1])
            least = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
            size = 1
            while size * 2 <= w:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < w:
                least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
            at = (least & _LOW).astype(np.int32)
            fits = np.cumsum(step[lo:hi], dtype=np.int8)
            fits += np.int8(inside)
            inside = int(fits[-1])
            new = np.r_[True, (at[1:] != at[:-1]) | (fits[1:] != fits[:-1])]
            first = np.flatnonzero(new)
            end = np.r_[first[1:], hi - lo] - 1
            keep = fits[first] > 0
            first, end = first[keep], end[keep]
            found.append((first + lo, end + lo, at[first].astype(np.int64) + lo))
        a, b, at = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return
        joins = np.r_[False, (at[1:] == at[:-1]) & (a[1:] == b[:-1] + 1)]  # a piece's border cuts no context
        self.a, at = a[~joins], at[~joins]
        self.b = b[np.r_[~joins[1:], True]]
        self.gram = _grams_at(t, at)
        end = self.b + self.length
        mid = self.a + (end - self.a - 2 * GRAM) // 2
        shape = ((end - self.a) << 16 | (at - self.a)).astype(np.uint64)
        self.context = _mix(_mix(self._long(self.a), self._long(end - 2 * GRAM)), _mix(self._long(mid), shape))

    def _long(self, at: np.ndarray) -> np.ndarray:
        """Identifiers of 128 bytes."""
        return _mix(_grams_at(self.t, at), _grams_at(self.t, at + GRAM))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(identifier, anchor's identifier, start) of each window of the anchors ``which``."""
        size = self.b[which] - self.a[which] + 1
        s = np.repeat(self.a[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        later = self.length - 2 * GRAM
        name = np.zeros(len(s), np.uint64)
        for lo in range(0, len(s), PIECE):
            at = s[lo : lo + PIECE]
            name[lo : lo + PIECE] = _mix(self._long(at), self._long(at + later))
        return name, np.repeat(self.gram[which], size), s


def _parts(rows: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["kind", "bucket", "block", "n", "data"])


def _deal(kind: int, block: int, buckets: int, key: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """A row for each bucket that gets keys, with the arrays one after the other."""
    if not len(key):
        return []
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cols = [x[order] for x in (key, *more)]
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [(kind, int(to[i]), block, int(j - i), b"".join(c[i:j].tobytes() for c in cols)) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True)]


def _spans(block: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    return [(SPANS, -1, block, len(a), a.astype("<u4").tobytes() + b.astype("<u4").tobytes())] if len(a) else []


def _read(table: pa.Table, kind: int, *types: str) -> list[np.ndarray]:
    """The arrays of a kind, of all rows, and the block of each entry."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(types) + 1)]
    for k, block, n, data in zip(*[table.column(c).to_pylist() for c in ("kind", "block", "n", "data")], strict=True):
        if k != kind:
            continue
        at = 0
        for i, t in enumerate(types):
            out[i].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        out[-1].append(np.full(n, block, np.int32))
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, [*types, "i4"], strict=True)]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last counts first in lexsort's sense) and the number of each entry's run of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _ask(table: pa.Table, block: int, buckets: int, length: int) -> pa.Table:
    x = Block(table, length)
    x.anchors()
    rows: list[tuple] = []
    if len(x.a):
        order, run = _runs(x.context, x.gram)
        size = np.bincount(run)
        first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
        rows += _deal(CONTEXT, block, buckets, x.context[first], x.gram[first], x.a[first].astype("<u4"), x.b[first].astype("<u4"))
        twice = order[size[run] > 1]
        rows += _spans(block, x.a[twice], x.b[twice])
        g, c = x.gram[first], x.context[first]
        order = np.lexsort((c, g))
        g, c = g[order], c[order]
        third = np.r_[False, False, g[2:] == g[:-2]] if len(g) > 2 else np.zeros(len(g), bool)
        rows += _deal(ANCHOR, block, buckets, g[~third], c[~third])
    return _parts(rows)


def _answer(table: pa.Table, bucket: int) -> pa.Table:
    """To each block: contexts that other blocks have too (with the first of those blocks), and anchors with differing contexts."""
    rows: list[tuple] = []
    context, gram, a, b, block = _read(table, CONTEXT, "<u8", "<u8", "<u4", "<u4")
    if len(context):
        order, run = _runs(block, context, gram)
        run = np.cumsum(np.r_[False, (context[order][1:] != context[order][:-1]) | (gram[order][1:] != gram[order][:-1])])
        shared = np.bincount(run)[run] > 1
        who = block[order]
        lead = who[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])][run]
        at = order[shared]
        rows += _by_block(CONTEXT, bucket, block[at], context[at], gram[at], a[at], b[at], (lead[shared] == who[shared]).astype(np.uint8))
    gram, context, block = _read(table, ANCHOR, "<u8", "<u8")
    if len(gram):
        order = np.lexsort((context, gram))
        g, c = gram[order], context[order]
        run = np.cumsum(np.r_[False, g[1:] != g[:-1]])
        differs = np.bincount(run, np.r_[0, (g[1:] == g[:-1]) & (c[1:] != c[:-1])]) > 0
        at = order[differs[run]]
        pair = np.unique(np.stack([block[at].astype(np.uint64), gram[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
        rows += _by_block(ANCHOR, bucket, pair[0].astype(np.int32), pair[1])
    return _parts(rows)


def _by_block(kind: int, bucket: int, block: np.ndarray, *cols: np.ndarray) -> list[tuple]:
    if not len(block):
        return []
    order = np.argsort(block, kind="stable")
    who = block[order]
    cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    return [(kind, bucket, int(who[i]), int(j - i), b"".join(c[order[i:j]].tobytes() for c in cols)) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(who)], strict=True)]


def _refine(table: pa.Table, answers: pa.Table, block: int, buckets: int, length: int) -> pa.Table:
    """Windows of anchors with differing contexts: of contexts that are not shared, and of shared ones in the first block that has them."""
    rows: list[tuple] = []
    context, gram, a, b, lead, _ = _read(answers, CONTEXT, "<u8", "<u8", "<u4", "<u4", "u1")
    rows += _spans(block, a, b)
    (several, _) = _read(answers, ANCHOR, "<u8")
    if len(several):
        x = Block(table, length)
        x.anchors()
        mine = np.isin(x.gram, several)
        pair = _mix(x.context, x.gram)
        settled = np.isin(pair, _mix(context[lead == 0], gram[lead == 0]))
        which = np.flatnonzero(mine & ~settled)
        _, once = np.unique(pair[which], return_index=True)  # equal contexts within the block have the same windows
        name, anchor, s = x.windows(which[once])
        known = np.isin(pair[which[once]], _mix(context, gram)) | (np.bincount(np.searchsorted(np.unique(pair[which]), pair[which]))[: len(once)] > 1)
        known = np.repeat(known, x.b[which[once]] - x.a[which[once]] + 1)  # removed already; others need to meet them
        order, run = _runs(anchor, name)
        size = np.bincount(run)
        first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
        twice = order[(size[run] > 1) & ~known[order]]
        rows += _spans(block, s[twice], s[twice])
        rows += _deal(WINDOW, block, buckets, name[first], (anchor[first] >> np.uint64(32)).astype("<u4"), s[first].astype("<u4"))
    return _parts(rows)


def _settle(table: pa.Table, bucket: int) -> pa.Table:
    """To each block: the windows that other blocks have too."""
    name, anchor, s, block = _read(table, WINDOW, "<u8", "<u4", "<u4")
    rows: list[tuple] = []
    if len(name):
        order, run = _runs(anchor, name)
        at = order[np.bincount(run)[run] > 1]
        rows += _by_block(SPANS, bucket, block[at], s[at], s[at])
    return _parts(rows)


def _cut(table: pa.Table, answers: pa.Table, length: int) -> tuple[Block, list[list[tuple[int, int]]]]:
    """The block and, for each of its documents in order, the maximal removed runs."""
    x = Block(table, length)
    a, b, _ = _read(answers, SPANS, "<u4", "<u4")
    out: list[list[tuple[int, int]]] = [[] for _ in x.raw]
    if len(a):
        order = np.argsort(a)
        lo, hi = a[order].astype(np.int64), b[order].astype(np.int64) + length
        doc = np.searchsorted(x.ends, lo, side="right")
        reach = np.maximum.accumulate(hi)
        new = np.r_[True, (lo[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        for d, i, j in zip(doc[first].tolist(), lo[first].tolist(), reach[np.r_[first[1:] - 1, len(lo) - 1]].tolist(), strict=True):
            out[d].append((i - int(x.starts[d]), j - int(x.starts[d])))
    return x, out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for i, j in spans:
        out.append(raw[at:i])
        at = j
    return b"".join([*out, raw[at:]])


def _run(docs: DataFrame, length: int, finish, schema: StructType) -> DataFrame:
    """``finish(table, block, spans)`` gives the rows of a block."""
    if not 2 * GRAM <= length <= 4 * GRAM:
        raise ValueError(f"length must be within {2 * GRAM} and {4 * GRAM}")
    n = block_count(docs, BLOCK_BYTES)
    key = fresh(docs, "block")
    blocked = docs.withColumn(key, dealt(n))
    by_block = lambda df: df.groupBy(key if key in df.columns else "block")
    empty = _parts([])

    def ask(table: pa.Table) -> pa.Table:
        return _ask(table, table.column(key)[0].as_py(), n, length)

    def answer(table: pa.Table) -> pa.Table:
        return _answer(table, table.column("bucket")[0].as_py())

    def refine(left: pa.Table, right: pa.Table) -> pa.Table:
        return _refine(left, right, left.column(key)[0].as_py(), n, length) if left.num_rows else empty

    def settle(table: pa.Table) -> pa.Table:
        return _settle(table, table.column("bucket")[0].as_py())

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        x, spans = _cut(left, right, length)
        return finish(left, x, spans)

    asked = by_block(blocked).applyInArrow(spared(ask), PART)
    own = asked.filter(F.col("kind") == SPANS)
    answers = asked.filter(F.col("kind") != SPANS).groupBy("bucket").applyInArrow(spared(answer), PART)
    refined = by_block(blocked).cogroup(by_block(answers)).applyInArrow(spared(refine), PART)
    settled = refined.filter(F.col("kind") == WINDOW).groupBy("bucket").applyInArrow(spared(settle), PART)
    spans = own.unionByName(refined.filter(F.col("kind") == SPANS)).unionByName(settled)
    return by_block(blocked).cogroup(by_block(spans)).applyInArrow(spared(end), schema)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs as ``spans``."""
    schema = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    schema = StructType([*docs.select("doc_id").schema.fields, *schema.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(table: pa.Table, x: Block, spans: list) -> pa.Table:
        cols = [
            table.column("doc_id").take(pa.array(x.order, pa.int64())),
            pa.array([len(r) for r in x.raw], pa.int64()),
            pa.array([sum(j - i for i, j in s) for s in spans], pa.int64()),
            pa.array([len(s) for s in spans], pa.int64()),
            pa.array([hashlib.sha256(_kept(r, s)).hexdigest() for r, s in zip(x.raw, spans, strict=True)], pa.string()),
            pa.array([[{"start": i, "end": j} for i, j in s] for s in spans], kind),
        ]
        return pa.table(cols, names=schema.names)

    return _run(docs.select("doc_id", "text"), length, finish, schema)


def deduped(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated bytes cut out; ``n_chars``, where there is one, follows. Texts left empty stay as rows."""
    schema = docs.schema

    def finish(table: pa.Table, x: Block, spans: list) -> pa.Table:
        table = table.take(pa.array(x.order, pa.int64()))
        texts = [None if t is None else _kept(r, s).decode("utf-8", "ignore") for t, r, s in zip(table.column("text").to_pylist(), x.raw, spans, strict=True)]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
        return pa.table([new[f.name].cast(table.column(f.name).type) if f.name in new and isinstance(f.dataType, StringType | IntegerType | type(schema["doc_id"].dataType)) else table.column(f.name) for f in schema], names=schema.names)

    return _run(docs, length, finish, schema)
