"""Katz backoff scoring.

Words get ids by a table of counts; pairs of ids are counted in buckets by context; Good-Turing discounts come
from counts of counts; each context's backoff weight is the mass that its discounted pairs leave over the
mass that unseen words have one order below, so that probabilities sum to exactly 1:

    P(w | v) = d_r r / D(v)         if the pair occurs r > 0 times in training
             = a(v) P(w)            else, by recursion
             = P(w)                 if the context is unknown
    P(w)     = d_c c / D            if the word occurs c > 0 times
             = what is left         for all unknown words together

D(v) is the context's count, one more where nothing would be left otherwise. Counts up to ``K`` = 5 are
discounted after Katz; where counts of counts do not allow it (a discount outside 0 .. 1), by n1 / (n1 + 2 n2).

Texts move once, into blocks. Blocks and buckets exchange distinct keys only; a context with more than a
bucket's share of tokens is split by following word, and the parts' sums meet in the context's own bucket. The driver gets sums of
fixed width. Ids and counts are written in as many bytes as they need.
Tables in the shared folder, partitioned by kind: the vocabulary, the encoded blocks, the pair counts with
their contexts' sums, and the buckets' replies.

Defined results: null texts count as empty and have the end token alone; without training rows every
probability is that of an unknown word, 1; repeated rows are rows of their own. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.common import block_count, dealt, release, spared, split_words, stored

K, BLOCK_BYTES = 5, 12_000_000
END, BOS, UNKNOWN, FIRST = b"\n", 2, 0, 3
VOCAB, STATS, REPLY, ENCODED, MODEL, SUMS, ASK = range(1, 8)
PART = "kind int, bucket int, block int, n int, data binary"
NAMES = ["kind", "bucket", "block", "n", "data"]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, as byte planes; the number of planes comes first."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(data: bytes, *sizes: int, at: int = 0) -> tuple:
    """Arrays packed one after the other, and where they end."""
    found = []
    for n in sizes:
        planes = data[at]
        out = np.zeros((n, 8), np.uint8)
        out[:, :planes] = np.frombuffer(data, np.uint8, planes * n, at + 1).reshape(planes, n).T
        found.append(out.view("<i8").reshape(n))
        at += 1 + planes * n
    return *found, at


def parts(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=NAMES)


def rows_of(table: pa.Table, kind: int) -> list[tuple]:
    """(bucket, block, n, data) of one kind, in order of bucket and block."""
    found = zip(*[table.column(c).to_pylist() for c in NAMES], strict=True)
    return sorted(((u, b, n, d) for k, u, b, n, d in found if k == kind), key=lambda r: r[:2])


# --- words ------------------------------------------------------------------------------------------


class Words:
    """A block's documents in a fixed order and their words as local numbers; the last number is the end token."""

    def __init__(self, table: pa.Table):
        self.order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending"), ("train", "ascending")], null_placement="at_start")
        self.train = table.column("train").take(self.order).to_pylist()
        codes, sizes, words = split_words(table.column("text").take(self.order))
        self.sizes = (sizes + 1).tolist()
        keys = [*words.to_pylist(), END]
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        place = np.argsort(hashed)
        self.hash = hashed[place]
        rank = np.empty(len(keys), np.int64)
        rank[place] = np.arange(len(keys))
        self.end = int(rank[-1])
        self.tokens = rank[np.insert(codes, np.cumsum(sizes), len(keys) - 1)]

    def counts(self) -> np.ndarray:
        keep = np.repeat(np.array(self.train, bool), self.sizes)
        return np.bincount(self.tokens[keep], minlength=len(self.hash))


def _ask_words(table: pa.Table, block: int, buckets: int) -> pa.Table:
    w = Words(table)
    n, to = w.counts(), (w.hash % np.uint64(buckets)).astype(np.int64)
    rows = []
    for u in np.unique(to).tolist():
        at = np.flatnonzero(to == u)
        rows.append((VOCAB, u, block, len(at), w.hash[at].tobytes() + pack(n[at])))
    return parts(rows)


def _count_words(table: pa.Table, bucket: int, buckets: int) -> pa.Table:
    """The bucket's vocabulary (hash, id, count), its statistics, and to each block the ids and counts of its words."""
    asked = rows_of(table, VOCAB)
    h = np.concatenate([np.frombuffer(d, "<u8", n) for _, _, n, d in asked])
    c = np.concatenate([unpack(d, n, at=8 * n)[0] for _, _, n, d in asked])
    words, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, c).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -total))] = np.arange(len(words))  # frequent words get small ids
    ids = np.where(total > 0, FIRST + rank * buckets + bucket, UNKNOWN)
    seen = total > 0
    rows = [(VOCAB, bucket, -1, int(seen.sum()), words[seen].tobytes() + pack(ids[seen]) + pack(total[seen]))]
    rows.append((STATS, bucket, -1, 1, np.r_[total.sum(), seen.sum(), [np.count_nonzero(total == r) for r in range(1, K + 2)]].astype("<i8").tobytes()))
    at = 0
    for _, block, n, _ in asked:
        own = inverse[at : at + n]
        rows.append((REPLY, bucket, block, n, pack(ids[own]) + pack(total[own])))
        at += n
    return parts(rows)


def _encode(table: pa.Table, replies: pa.Table, block: int, buckets: int, schema: StructType) -> pa.Table:
    w = Words(table)
    ids, counts = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
    to = (w.hash % np.uint64(buckets)).astype(np.int64)
    for u, _, n, d in rows_of(replies, REPLY):
        at = np.flatnonzero(to == u)
        ids[at], counts[at], _ = unpack(d, n, n)
    known = np.flatnonzero(ids)
    known = known[np.argsort(ids[known])]
    n = len(w.tokens)
    data = pack(np.array([len(known)])) + pack(ids[w.tokens]) + pack(ids[known]) + pack(counts[known])
    doc_id = table.column("doc_id").combine_chunks().take(w.order)
    one = lambda x, t: pa.array([x], t)
    return pa.table(
        [one(ENCODED, pa.int32()), one(-1, pa.int32()), one(block, pa.int32()), one(n, pa.int32()), one(data, pa.binary()), pa.ListArray.from_arrays([0, len(doc_id)], doc_id), one(w.sizes, pa.list_(pa.int32())), one(w.train, pa.list_(pa.bool_()))],
        names=schema.names,
    )


# --- pairs ------------------------------------------------------------------------------------------


class Pairs:
    """A block's encoded tokens with the token before each, and its distinct pairs of known words by bucket."""

    def __init__(self, n: int, data: bytes, sizes: list[int], train: list[bool], buckets: int, share: int):
        known, at = unpack(data, 1)
        self.tokens, self.ids, self.counts, _ = unpack(data, n, int(known[0]), int(known[0]), at=at)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.r_[BOS, self.tokens[:-1]] if n else self.tokens
        self.before[self.starts] = BOS
        keep = np.repeat(np.array(train, bool), self.sizes)
        # contexts in the order of ids, with their training counts; the start of a text counts as often as its end
        self.v = np.unique(self.before[self.before != UNKNOWN]) if n else self.before
        self.v_of = np.searchsorted(self.v, self.before)
        self.w_of = np.searchsorted(self.ids, self.tokens)
        usable = (self.before != UNKNOWN) & (self.tokens != UNKNOWN)
        key = self.v_of[usable] * (len(self.ids) + 1) + self.w_of[usable]
        self.keys, inverse = np.unique(key, return_inverse=True)
        self.pair_of = np.full(n, -1, np.int64)
        self.pair_of[usable] = inverse
        self.trained = np.bincount(inverse[keep[usable]], minlength=len(self.keys))
        self.pv, self.pw = self.keys // (len(self.ids) + 1), self.keys % (len(self.ids) + 1)
        self.buckets, self.share = buckets, share

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        return np.where(self.ids[at] == ids, self.counts[at], 0) if len(self.ids) else np.zeros(len(ids), np.int64)

    def deal(self, ends: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each bucket (contexts, pairs), as indices. ``ends``: the training count of the end token."""
        self.v_count = np.where(self.v == BOS, ends, self.count_of(self.v))
        split = 1 + self.v_count // self.share
        part = self.ids[self.pw] % split[self.pv] if len(self.keys) else self.pw
        to = (self.v[self.pv] * 7919 + part * 104729) % self.buckets
        plain = home(self.v, self.buckets)  # a context asks in its first part's bucket also if it has no pair there
        pairs = np.unique(np.concatenate([to * (len(self.v) + 1) + self.pv, plain * (len(self.v) + 1) + np.arange(len(self.v))]))
        vb, vi = pairs // (len(self.v) + 1), pairs % (len(self.v) + 1)
        order = np.argsort(to, kind="stable")
        out = {}
        for u in np.unique(vb).tolist():
            lo, hi = np.searchsorted(to[order], [u, u + 1])
            a, b = np.searchsorted(vb, [u, u + 1])
            out[u] = (vi[a:b], order[lo:hi])
        return out


def home(v: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket where blocks ask for a context."""
    return v * 7919 % buckets


def _ask_pairs(row: dict, buckets: int, share: int, ends: int) -> list[tuple]:
    x = Pairs(row["n"], row["data"], row["sizes"], row["train"], buckets, share)
    rows = []
    for u, (v, p) in x.deal(ends).items():
        p = p[np.argsort(x.pv[p], kind="stable")]
        length = np.bincount(np.searchsorted(v, x.pv[p]), minlength=len(v))
        word = x.pw[p]
        data = pack(np.array([len(v)])) + pack(x.v[v]) + pack(x.v_count[v]) + pack(length) + pack(x.ids[word]) + pack(x.trained[p]) + pack(x.counts[word])
        rows.append((MODEL, u, row["block"], len(p), data))
    return rows


def _count_pairs(table: pa.Table, bucket: int, buckets: int) -> pa.Table:
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    asked, rows = rows_of(table, MODEL), []
    for _, block, n, d in asked:
        size, at = unpack(d, 1)
        k = int(size[0])
        v, vc, length, w, c, cw, _ = unpack(d, k, k, k, n, n, n, at=at)
        for to, x in zip(cols, (np.repeat(v, length), w, c, cw, v, vc), strict=True):
            to.append(x)
        own = v[home(v, buckets) == bucket]
        rows.append((ASK, bucket, block, len(own), pack(own)))
    v, w, c, cw, contexts, context_counts = (np.concatenate(x) for x in cols)
    order = np.lexsort((w, v))
    run = np.cumsum(np.r_[False, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])]) if len(v) else order
    total = np.bincount(run, c[order]).astype(np.int64) if len(v) else order
    back = np.empty(len(v), np.int64)
    back[order] = run
    at = 0
    for _, block, n, _ in asked:
        rows.append((REPLY, bucket, block, n, pack(total[back[at : at + n]])))
        at += n
    first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] if len(v) else order
    seen = total > 0
    pv, pw, pc, r = v[first][seen], w[first][seen], cw[first][seen], total[seen]
    rows.append((MODEL, bucket, -1, len(r), pack(pv) + pack(pw) + pack(r)))
    rows.append((STATS, bucket, -1, 1, np.array([r.sum(), len(r), *[np.count_nonzero(r == i) for i in range(1, K + 2)]], "<i8").tobytes()))
    name, once = np.unique(contexts, return_index=True)
    at = np.searchsorted(name, pv)
    count = lambda keep, weight=None: np.bincount(at[keep], None if weight is None else weight[keep], len(name)).astype("<i8")
    sums = np.stack([*[count(r == i) for i in range(1, K + 1)], count(r > K, r), *[count(pc == i) for i in range(1, K + 1)], count(pc > K, pc), context_counts[once].astype("<i8")])
    to = home(name, buckets)
    for u in np.unique(to).tolist():  # parts of a split context go to where blocks ask for it
        at = to == u
        rows.append((SUMS, u, -1, int(at.sum()), pack(name[at]) + b"".join(pack(row[at]) for row in sums)))
    return parts(rows)


# --- the model --------------------------------------------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """d_1 .. d_K after Katz, from the numbers of types that occur 1 .. K + 1 times."""
    n = n.astype(float)
    if n[0] <= 0:
        return np.ones(K)
    common = (K + 1) * n[K] / n[0]
    with np.errstate(all="ignore"):
        d = np.array([((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, K + 1)])
    if not np.all(np.isfinite(d)) or (d <= 0).any() or (d > 1).any():
        cut = n[0] / (n[0] + 2 * n[1]) if n[1] > 0 else 0.5
        d = (np.arange(1, K + 1) - cut) / np.arange(1, K + 1)
    return d


class Levels:
    """Discounts and totals of both orders."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.tokens, self.types = int(words[0]), int(words[1])
        self.d1, self.d2 = discounts(words[2:]), discounts(pairs[2:])
        r = np.arange(1, K + 1)
        n = words[2 : 2 + K]
        kept = float((self.d1 * r * n).sum()) + (self.tokens - float((r * n).sum()))
        self.total = self.tokens if kept < self.tokens - 1e-9 else self.tokens + 1
        self.unknown = (self.total - kept) / self.total

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.r_[0.0, self.d1, 1.0][np.minimum(c, K + 1)] * c / self.total, self.unknown)

    def context(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """D and a of contexts, by columns of sums."""
        r = np.arange(1, K + 1)[:, None]
        count = sums[-1].astype(float)
        kept = (self.d2[:, None] * r * sums[:K]).sum(0) + sums[K]
        below = ((self.d1[:, None] * r * sums[K + 1 : 2 * K + 1]).sum(0) + sums[2 * K + 1]) / self.total
        d = np.where(kept < count - 1e-9, count, count + 1)
        return d, (1 - kept / d) / (1 - below)


def _params(table: pa.Table, levels: Levels) -> pa.Table:
    """To each block: D and a of the contexts that it asks for, from the sums of all their parts."""
    v, sums = [np.zeros(0, np.int64)], [np.zeros((2 * K + 3, 0), np.int64)]
    for _, _, n, d in rows_of(table, SUMS):
        name, *rows, _ = unpack(d, *[n] * (2 * K + 4))
        v.append(name)
        sums.append(np.stack(rows))
    v, sums = np.concatenate(v), np.concatenate(sums, axis=1)
    order = np.argsort(v, kind="stable")
    v, sums = v[order], sums[:, order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else order
    name, found = v[first], np.add.reduceat(sums, first, axis=1) if len(v) else sums
    found[-1] = sums[-1, first]  # every part has the whole count
    d, a = levels.context(found)
    rows = []
    for u, block, n, data in rows_of(table, ASK):
        at = np.searchsorted(name, unpack(data, n)[0])
        rows.append((SUMS, u, block, n, d[at].tobytes() + a[at].tobytes()))
    return parts(rows)


def _score(row: dict, replies: pa.Table, levels: Levels, buckets: int, share: int, ends: int) -> tuple[np.ndarray, ...]:
    x = Pairs(row["n"], row["data"], row["sizes"], row["train"], buckets, share)
    dealt = x.deal(ends)
    r, d, a = np.zeros(len(x.keys) + 1, np.int64), np.ones(len(x.v) + 1), np.ones(len(x.v) + 1)
    for u, _, n, data in rows_of(replies, REPLY):
        p = dealt[u][1]
        r[p[np.argsort(x.pv[p], kind="stable")]] = unpack(data, n)[0]
    for u, _, n, data in rows_of(replies, SUMS):
        v = dealt[u][0][home(x.v[dealt[u][0]], buckets) == u]
        d[v], a[v] = np.frombuffer(data, "<f8", n), np.frombuffer(data, "<f8", n, 8 * n)
    c = x.count_of(x.tokens)
    word = levels.word(c)
    has = (x.before != UNKNOWN) & (np.r_[x.v_count, 0][np.minimum(x.v_of, len(x.v))] > 0)
    n, at = r[x.pair_of], np.minimum(x.v_of, len(x.v))  # without a pair: the last entry, 0
    pair = np.r_[0.0, levels.d2, 1.0][np.minimum(n, K + 1)] * n / d[at]
    p = np.where(~has, word, np.where(n > 0, pair, a[at] * word))
    base = np.log10((c + 1) / (levels.tokens + levels.types + 1))
    add = lambda y: np.add.reduceat(y, x.starts) if len(x.starts) else y[:0]
    return x.sizes, add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def _total(df: DataFrame, kind: int) -> np.ndarray:
    """Sums the statistics of all buckets: partitions add theirs up, then a few rows are left."""

    def run(batches):
        out = np.zeros(K + 3, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                out += np.frombuffer(data, "<i8", K + 3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(K + 3)), pa.array(out)], names=["i", "n"])

    found = df.filter(F.col("kind") == kind).select("data").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(K + 3, np.int64)
    for r in found.collect():
        out[r["i"]] = r["n"]
    return out


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    n = block_count(docs, BLOCK_BYTES)
    src = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"), dealt(n).alias("block"))
    id_type = docs.schema["doc_id"].dataType
    wide = StructType.fromDDL(PART + f", doc_id array<{id_type.simpleString()}>, sizes array<int>, train array<boolean>")

    def ask(t: pa.Table) -> pa.Table:
        return _ask_words(t, t.column("block")[0].as_py(), n)

    def count(t: pa.Table) -> pa.Table:
        return _count_words(t, t.column("bucket")[0].as_py(), n)

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        return _encode(left, right, left.column("block")[0].as_py(), n, wide)

    counted = src.groupBy("block").applyInArrow(spared(ask), PART).groupBy("bucket").applyInArrow(spared(count), PART)
    replies = counted.filter(F.col("kind") == REPLY)
    encoded = src.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(spared(encode), wide)
    words = stored(encoded.unionByName(counted.filter(F.col("kind").isin(VOCAB, STATS)), allowMissingColumns=True), "katz-words", ("kind",))
    release(spark)
    level1 = _total(words, STATS)
    end_hash = np.uint64(xxhash.xxh64_intdigest(END))
    where = words.filter((F.col("kind") == VOCAB) & (F.col("bucket") == int(end_hash % np.uint64(n)))).select("n", "data").head()
    ends = 0
    if where is not None:
        at = np.flatnonzero(np.frombuffer(where["data"], "<u8", where["n"]) == end_hash)
        ends = int(unpack(where["data"], where["n"], where["n"], at=8 * where["n"])[1][at].sum())
    share = max(1, int(level1[0]) // n)
    blocks = words.filter(F.col("kind") == ENCODED).select("block", "n", "data", "doc_id", "sizes", "train")

    def ask_pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).select(["block", "n", "data", "sizes", "train"]).to_pylist()[0]
                yield from parts(_ask_pairs(row, n, share, ends)).to_batches()

    def count_pairs(t: pa.Table) -> pa.Table:
        return _count_pairs(t, t.column("bucket")[0].as_py(), n)

    pairs = stored(blocks.mapInArrow(ask_pairs, PART).groupBy("bucket").applyInArrow(spared(count_pairs), PART), "katz-pairs", ("kind",))
    release(spark)
    levels = Levels(level1, _total(pairs, STATS))

    def params(t: pa.Table) -> pa.Table:
        return _params(t, levels)

    out = StructType.fromDDL(f"doc_id {id_type.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["block", "n", "data", "sizes", "train"]).to_pylist()[0]
        size, known, base, p = _score(row, right, levels, n, share, ends)
        ids = left.column("doc_id").combine_chunks().flatten()
        return pa.table([ids, pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array([levels.tokens] * len(size), pa.int64()), pa.array(base), pa.array(p)], names=out.names)

    answers = pairs.filter(F.col("kind").isin(SUMS, ASK)).groupBy("bucket").applyInArrow(spared(params), PART)
    answers = answers.unionByName(pairs.filter(F.col("kind") == REPLY).select(*NAMES))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(spared(final), out)
