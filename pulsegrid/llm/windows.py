"""Near-duplicate passages by compact windows.

A text's tokens are its five-word shingles. Under each of ``FUNCTIONS`` hashes, the Cartesian tree of the
shingles' hashes has a node for every shingle that is the least of some passage of ``length`` shingles or more; the
node's span, its compact window, holds all passages that share that minimum. Windows are joined as intervals: a
candidate is a minimum whose window, in its document, has in common with the window of another hash, whose minimum other documents share too, an
interval that is long enough and holds both minima. So two hashes of four must agree on a passage. A pair of
similarity 0.8 becomes a candidate with probability 0.97, one of 0.9 with 0.996; a verbatim passage of over 50 words
shares its minimum under every hash, wherever that lies.

A minimum that all its occurrences share with the 47 shingles that end there, surround it or begin there needs no more: its documents
share a verbatim passage. For the others the shingles of their windows travel (at most 90 on either side: a longer passage has a half of 46
shingles or more that is as similar, with minima of its own), and candidates are verified: two are linked
where passages of the same extents around the minimum, of 46 to 181 shingles, have a similarity of 0.8 or more; shared
shingles are counted by place, each once, and the best extents are found exactly. Candidates of
one minimum are searched breadth-first; the prefix filter on rare shingles loses no pair, and no link hides another.

A group never yields all its pairs, only a star of its least document for each linked set. Blocks and buckets exchange distinct keys, one
entry per key and block; equal windows of a block travel once; links are made distinct in packed form.

Defined results: null texts count as empty; texts of fewer than ``length`` shingles have no links; rows that repeat a doc_id are one
document; null doc_ids keep their rows, without class or links. ``n_links`` is the number of other documents in the class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import block_count, dealt, release, spared, split_words, stored
from pulsegrid.llm.components import components
from pulsegrid.llm.suffix import PART, _by_block, _deal, _mix, _parts, _read

SHINGLE, LENGTH, FUNCTIONS, AROUND, BLOCK_BYTES = 5, 46, 4, 90, 6_000_000
#: shingles that make a verbatim passage; shingles by which a window is widened, for inserted words
STRING, SLACK = 47, 6
WIDE = 2 * AROUND + 1
KEY, SAME, NEAR, EDGE = 1, 2, 3, 4


def _seed(i: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"min-hash", i)], np.uint64)


class Shingles:
    """The shingles of a block's documents end to end; ``doc``: the document of each, ``ends``: where each document's end."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        ids = table.column("doc_id").to_numpy()
        table = table.filter(table.column("doc_id").is_valid()) if table.column("doc_id").null_count else table
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order].astype(np.int64)
        words, sizes, distinct = split_words(table.column("text").take(pa.array(order)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
        w = hashes[words]
        x = w
        for k in range(1, SHINGLE):
            x = _mix(x[: max(0, len(w) - k)], w[k:])
        own = np.maximum(sizes - SHINGLE + 1, 0)  # the last words of a text start none
        left = np.ones(len(w), bool)
        stop = np.cumsum(sizes)
        for k in range(1, SHINGLE):
            left[(stop - k)[sizes >= k]] = False
        self.x = x[left[: len(x)]]
        self.ends = np.cumsum(own, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(own)), own)


def _nodes(h: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (with their packed hashes) that are the least of some passage of ``length`` within a document; leftmost among equals."""
    n = len(h)
    bits = np.uint64(max(24, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (h & ~low) | np.arange(n, dtype=np.uint64)
    least, size = packed, 1
    while size * 2 <= length:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < length:
        least = np.minimum(least[: len(least) - (length - size)], least[length - size :])
    at = (least & low).astype(np.int64)[np.arange(len(least)) + length <= ends[doc[: len(least)]]]
    c = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at  # the least moves to the right only
    return c, packed[c]


def _spans(c: np.ndarray, value: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each node's span: the nearest smaller nodes are ancestors in the tree, so they are among ``c`` themselves."""
    l, r = np.r_[0, ends][of].tolist(), (ends[of] - 1).tolist()
    v, place, doc, stack = value.tolist(), c.tolist(), of.tolist(), []
    for i, x in enumerate(v):
        while stack and (doc[stack[-1]] != doc[i] or v[stack[-1]] > x):
            j = stack.pop()
            if doc[j] == doc[i]:
                r[j] = place[i] - 1
        if stack:
            l[i] = place[stack[-1]] + 1
        stack.append(i)
    return np.array(l, np.int64), np.array(r, np.int64)


def compact_windows(h: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian trees' nodes whose span within a document has ``length`` positions or more."""
    if len(h) < length:
        return (np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    c, value = _nodes(h, ends, doc, length)
    return c, *_spans(c, value, ends, doc[c])


def _minima(s: Shingles, length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """key and c of the minima under all functions, and those of each function with their packed hashes."""
    if len(s.x) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    found = [_nodes(_mix(s.x, _seed(f)), s.ends, s.doc, length) for f in range(FUNCTIONS)]
    c = np.unique(np.concatenate([x for x, _ in found]))
    return _mix(s.x[c], _seed(100)), c, found


def _witnessed(spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each function, which of its windows (c, l, r) meet one of another function in an interval of ``length`` or more that holds both minima."""
    out = []
    for f, (c, l, r) in enumerate(spans):
        hit = np.zeros(len(c), bool)
        for g, (d, m, n) in enumerate(spans):
            if g == f or not len(d):
                continue
            at = np.searchsorted(d, c)
            for way, j in ((1, at), (-1, at - 1)):
                live = np.flatnonzero(~hit)
                k = j[live]
                while len(live):
                    near = (k >= 0) & (k < len(d))
                    near[near] = np.abs(d[k[near]] - c[live[near]]) <= 2 * AROUND
                    live, k = live[near], k[near]
                    lo, hi = np.maximum(l[live], m[k]), np.minimum(r[live], n[k])
                    low, high = np.minimum(c[live], d[k]), np.maximum(c[live], d[k])
                    ok = (hi - lo + 1 >= length) & (lo <= low) & (high <= hi)
                    hit[live[ok]] = True
                    live, k = live[~ok], k[~ok] + way
        out.append(hit)
    return out


def _joined(s: Shingles, c: np.ndarray, shared: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the minima ``c`` are witnessed by two functions or more that other documents share there, and the first and last place of their widest such window."""
    spans, place = [], []
    for at, value in found:
        l, r = _spans(at, value, s.ends, s.doc[at])
        i = np.searchsorted(c, at)
        keep = shared[i]
        spans.append((at[keep], l[keep], r[keep]))
        place.append(i[keep])
    near, first, last = np.zeros(len(c), bool), c.copy(), c.copy()
    for (_, l, r), i, hit in zip(spans, place, _witnessed(spans, length), strict=True):
        near[i[hit]] = True
        first[i[hit]] = np.minimum(first[i[hit]], l[hit])
        last[i[hit]] = np.maximum(last[i[hit]], r[hit])
    doc = s.doc[c]
    first = np.maximum(np.maximum(first - SLACK, c - AROUND), np.r_[0, s.ends][doc])
    return near, first, np.minimum(np.minimum(last + SLACK, c + AROUND), s.ends[doc] - 1)


def _strings(s: Shingles, c: np.ndarray, length: int) -> np.ndarray:
    """Identifiers (48 bits, three rows) of the ``STRING`` shingles that end at, surround and begin at each place; 0 where they leave its document or would be too few."""
    doc = s.doc[c]
    out = np.zeros((3, len(c)), np.uint64)
    if len(s.x) < STRING or length > STRING:
        return out
    fits, at = [], []
    for back in (STRING - 1, STRING // 2, 0):
        ok = (c - back >= np.r_[0, s.ends][doc]) & (c - back + STRING <= s.ends[doc])
        fits.append(ok)
        at.append(c[ok] - back)
    x, size, left, found = s.x, 1, STRING, [None] * 3
    while left:  # the bits of 47, each by strings of that length
        if left & 1:
            found = [x[p] if f is None else _mix(f, x[p]) for f, p in zip(found, at, strict=True)]
            at = [p + size for p in at]
        left >>= 1
        if left:
            x, size = _mix(x[:-size], x[size:]), 2 * size
    for row, ok, f in zip(out, fits, found, strict=True):
        row[ok] = np.maximum(f >> np.uint64(16), np.uint64(1))
    return out


def _agreed(strings: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run the string identifiers that all its entries have, else 0."""
    if not len(first):
        return strings[:, :0]
    least, most = np.minimum.reduceat(strings, first, axis=1), np.maximum.reduceat(strings, first, axis=1)
    return np.where(least == most, least, np.uint64(0))


def _ask(table: pa.Table, block: int, buckets: int, length: int) -> pa.Table:
    s = Shingles(table)
    key, c, _ = _minima(s, length)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
    found = _agreed(_strings(s, c, length)[:, order], first)
    return _parts(_deal(KEY, block, buckets, key[first], *[x for f in found for x in ((f & np.uint64(0xFFFFFFFF)).astype("<u4"), (f >> np.uint64(32)).astype("<u2"))]))


def _answer(table: pa.Table, bucket: int) -> pa.Table:
    """To each block: its keys that other blocks have too, and whether all occurrences agree on a string."""
    key, *parts, block = _read(table, KEY, "<u8", *["<u4", "<u2"] * 3)
    if not len(key):
        return _parts([])
    order = np.argsort(key, kind="stable")
    key, block = key[order], block[order]
    strings = np.stack([(lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32))[order] for lo, hi in zip(parts[::2], parts[1::2], strict=True)])
    new = np.r_[True, key[1:] != key[:-1]]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    same = (_agreed(strings, first) > 0).any(axis=0)
    at = (np.bincount(run) > 1)[run]  # a block has a key once
    return _parts(_by_block(KEY, bucket, block[at], key[at], same[run][at].astype(np.uint8)))


class Sets:
    """Which documents are connected; a set's name is its least document."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pair = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        for x, y in zip(*pair.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            self.root[max(x, y)] = min(x, y)

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that span the sets: each least document with every other of its set."""
        found = [(self.top(x), x) for x in self.root if self.top(x) != x]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets = Sets()
    sets.join(a, b)
    return sets.star()


def _edges(buckets: int, block: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    key = _mix(x.astype(np.uint64), y.astype(np.uint64))
    return [(EDGE, u, block, n, data) for _, u, _, n, data in _deal(EDGE, block, buckets, key, x.astype("<i8"), y.astype("<i8"))]


def _first_of_runs(order: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each entry of ``order`` the first entry of its run."""
    first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] if len(order) else order
    return first[run] if len(order) else order


def _contexts(s: Shingles, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each window in 32 bits (0 stands for none) one after the other, and an identifier of each."""
    size = last - first + 1
    starts = np.cumsum(size) - size
    at = np.repeat(first - starts, size) + np.arange(int(size.sum()))
    x = np.maximum(s.x >> np.uint64(32), np.uint64(1)).astype("<u4")[at]
    if not len(c):
        return x, np.zeros(0, np.uint64)
    place = np.arange(len(x)) - np.repeat(starts, size)
    mixed = _mix(x.astype(np.uint64), place.astype(np.uint64))
    return x, _mix(np.add.reduceat(mixed, starts), (size << 16 | (c - first)).astype(np.uint64))


def _passages(table: pa.Table, answers: pa.Table, block: int, buckets: int, length: int) -> pa.Table:
    """Of the minima that several documents share: one entry where all agree on a string, else each different window once."""
    known, same, _ = _read(answers, KEY, "<u8", "u1")
    s = Shingles(table)
    key, c, found = _minima(s, length)
    if not len(c):
        return _parts([])
    doc = s.doc[c]
    order = np.lexsort((doc, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    run, lead = np.cumsum(new) - 1, np.flatnonzero(new)
    several = np.bincount(run, np.r_[0, (~new[1:]) & (doc[order][1:] != doc[order][:-1])]) > 0
    k = key[order][lead]
    at = np.argsort(known)
    known, same = known[at], same[at]
    at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
    wide = known[at] == k if len(known) else np.zeros(len(k), bool)
    alike = (_agreed(_strings(s, c, length)[:, order], lead) > 0).any(axis=0)
    alike = np.where(wide, same[at] > 0, alike) if len(known) else alike
    a, b, rows = [], [], []
    # verbatim: the block links its own, other blocks hear of the least
    mine = order[(alike & (wide | several))[run]]
    rep = order[lead][run][(alike & (wide | several))[run]]
    a.append(s.ids[doc[mine]])
    b.append(s.ids[doc[rep]])
    send = order[lead][alike & wide]
    rows += _deal(SAME, block, buckets, key[send], s.ids[doc[send]].astype("<i8"))
    shared = np.zeros(len(c), bool)
    shared[order] = (wide | several)[run]
    near, first, last = _joined(s, c, shared, found, length)
    mine = order[(~alike & (wide | several))[run] & near[order]]
    x, whole = _contexts(s, c[mine], first[mine], last[mine])
    whole = _mix(whole, key[mine])
    by = np.lexsort((doc[mine], whole))
    run = np.cumsum(np.r_[False, whole[by][1:] != whole[by][:-1]]) if len(by) else by
    rep = _first_of_runs(by, run)
    a.append(s.ids[doc[mine[by]]])
    b.append(s.ids[doc[mine[rep]]])
    once = np.unique(rep)
    size = (last - first + 1)[mine]
    starts = np.cumsum(size) - size
    to = (key[mine[once]] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]]) if len(by) else by
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True) if len(by) else ():
        e = once[by[i:j]]
        own = np.concatenate([x[p : p + n] for p, n in zip(starts[e].tolist(), size[e].tolist(), strict=True)])
        g = mine[e]
        data = key[g].tobytes() + s.ids[doc[g]].astype("<i8").tobytes() + (c - first)[g].astype("u1").tobytes() + (last - c)[g].astype("u1").tobytes() + own.tobytes()
        rows.append((NEAR, int(to[by[i]]), block, int(j - i), data))
    return _parts(rows + _edges(buckets, block, *_star(np.concatenate(a), np.concatenate(b))))


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, document and the shingles around the minimum, 0 outside the window."""
    keys, docs, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, WIDE), np.uint32)]
    for kind, n, data in zip(*[table.column(c).to_pylist() for c in ("kind", "n", "data")], strict=True):
        if kind != NEAR:
            continue
        keys.append(np.frombuffer(data, "<u8", n))
        docs.append(np.frombuffer(data, "<i8", n, 8 * n))
        left, right = (np.frombuffer(data, "u1", n, 16 * n + k * n).astype(np.int64) for k in (0, 1))
        size = left + right + 1
        row = np.repeat(np.arange(n), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size + left - AROUND, size)
        out = np.zeros((n, WIDE), np.uint32)
        out[row, place] = np.frombuffer(data, "<u4", len(row), 18 * n)
        contexts.append(out)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(contexts)


def _alike(x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Which contexts ``y`` have a passage around the middle that is similar to the one of ``x`` of the same extents."""
    m, place = len(y), np.arange(-AROUND, AROUND + 1)
    order = np.argsort(x, kind="stable")
    at = np.minimum(np.searchsorted(x[order], y), WIDE - 1)
    other = order[at]
    same = (y == x) & (y > 0)
    moved = (x[other] == y) & (y > 0) & ~same
    if moved.any():  # a shingle that moved counts once, and not where its place in x has a partner
        row, col = np.nonzero(moved)
        to = other[row, col]
        _, once = np.unique(row * WIDE + to, return_index=True)
        once = once[~same[row[once], to[once]]]
        moved[:] = False
        moved[row[once], col[once]] = True
    o = np.where(same, place, place[other])
    left, right = np.maximum(-place, -o), np.maximum(place, o)
    hit = same | moved
    row = np.broadcast_to(np.arange(m)[:, None] * (AROUND + 1), y.shape)
    before, after = hit & (place < 0) & (o < 0), hit & (place > 0) & (o > 0)
    gain = [np.cumsum(np.bincount((row + e)[h], minlength=m * (AROUND + 1)).reshape(m, -1), axis=1) for e, h in ((left, before), (right, after))]
    # similarity 0.8 of n shingles each: 9 x shared >= 8 x n; extents stay within both documents
    step = np.arange(AROUND + 1)
    both = (y > 0) & (x > 0)
    a = np.where(both[:, AROUND::-1], 9 * gain[0] - 8 * step, -10_000)
    b = np.where(both[:, AROUND:], 9 * gain[1] - 8 * step, -10_000)
    b = np.maximum.accumulate(b[:, ::-1], axis=1)[:, ::-1]  # the best of this extent or more
    return (a + b[:, np.maximum(length - 1 - step, 0)] + 1 >= 0).any(axis=1)  # the shared minimum itself: 9 - 8


def _search(context: np.ndarray, length: int, of: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Links that connect groups of alike contexts; those with the same ``of`` are connected already."""
    m = len(context)
    of = list(range(m)) if of is None else of
    if m == 2:
        return ([0], [1]) if _alike(context[0], context[1:], length)[0] else ([], [])
    value, token, count = np.unique(context, return_inverse=True, return_counts=True)
    token = token.reshape(context.shape)
    rare = np.where(value == 0, m * WIDE + 1, count)
    need = -(-8 * length // 9)  # shared shingles at the least
    # contexts that share ``need`` shingles share one of those left when the need - 1 most frequent are set aside
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(rare, kind="stable")] = np.arange(len(value))
    several = np.empty(len(value), bool)
    several[rank] = count > 1
    prefix, where = [], {}
    for i in range(m):
        t = np.unique(rank[token[i][context[i] > 0]])
        p = t[: max(0, len(t) - need + 1)]
        prefix.append(p[several[p]].tolist())
        for k in prefix[-1]:
            where.setdefault(k, []).append(i)
    with_it: dict[int, list[int]] = {}
    for i, x in enumerate(of):
        with_it.setdefault(x, []).append(i)
    reached, a, b = [False] * m, [], []
    for start in range(m):
        if reached[start]:
            continue
        todo = list(with_it[of[start]])
        for x in todo:
            reached[x] = True
        while todo:
            x = todo.pop()
            near = set()
            for k in prefix[x]:
                where[k] = [y for y in where[k] if not reached[y]]
                near.update(where[k])
            if near:
                ys = np.array(sorted(near))
                for y in ys[_alike(context[x], context[ys], length)].tolist():
                    a.append(x)
                    b.append(y)
                    for z in with_it[of[y]]:
                        if not reached[z]:
                            reached[z] = True
                            todo.append(z)
    return a, b


def _link(table: pa.Table, bucket: int, buckets: int, length: int) -> pa.Table:
    # what a block linked by itself passes through, so that blocks are worked on once
    parts = zip(*[table.column(c).to_pylist() for c in ("kind", "bucket", "block", "n", "data")], strict=True)
    rows: list[tuple] = [r for r in parts if r[0] == EDGE]
    sets = Sets()
    key, doc, _ = _read(table, SAME, "<u8", "<i8")
    if len(key):
        order = np.lexsort((doc, key))
        run = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        sets.join(doc[order], doc[_first_of_runs(order, run)])
    name, doc, context = _windows(table)
    if len(name):
        whole = name.copy()
        for j in range(WIDE):
            whole = _mix(whole, context[:, j].astype(np.uint64))
        # equal windows are one entry
        order = np.lexsort((doc, whole))
        run = np.cumsum(np.r_[False, whole[order][1:] != whole[order][:-1]])
        rep = _first_of_runs(order, run)
        sets.join(doc[order], doc[rep])
        kept = np.unique(rep)
        order = kept[np.lexsort((doc[kept], name[kept]))]
        cut = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
        size = np.diff(np.r_[cut, len(order)])
        for i, n in sorted(zip(cut.tolist(), size.tolist(), strict=True), key=lambda x: x[1]):
            at = order[i : i + n]
            of = [sets.top(x) for x in doc[at].tolist()]
            if len(set(of)) > 1:  # else what a search could find is connected already
                x, y = _search(context[at], length, of)
                sets.join(doc[at[x]] if x else doc[:0], doc[at[y]] if y else doc[:0])
    return _parts(rows + _edges(buckets, -1, *sets.star()))


def links(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, b): documents that share a near-duplicate passage, the lesser first; enough links to span each class."""
    n = block_count(docs, BLOCK_BYTES)
    blocked = docs.select("doc_id", "text", dealt(n).alias("block"))

    def ask(t: pa.Table) -> pa.Table:
        return _ask(t, t.column("block")[0].as_py(), n, length)

    def answer(t: pa.Table) -> pa.Table:
        return _answer(t, t.column("bucket")[0].as_py())

    def passages(left: pa.Table, right: pa.Table) -> pa.Table:
        return _passages(left, right, left.column("block")[0].as_py(), n, length) if left.num_rows else _parts([])

    def link(t: pa.Table) -> pa.Table:
        return _link(t, t.column("bucket")[0].as_py(), n, length)

    def distinct(t: pa.Table) -> pa.Table:
        _, a, b, _ = _read(t, EDGE, "<u8", "<i8", "<i8")
        pair = np.unique(np.stack([a, b]), axis=1)
        return pa.table([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    answers = blocked.groupBy("block").applyInArrow(spared(ask), PART).groupBy("bucket").applyInArrow(spared(answer), PART)
    found = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(spared(passages), PART)
    return found.groupBy("bucket").applyInArrow(spared(link), PART).groupBy("bucket").applyInArrow(spared(distinct), "a long, b long")


def passage_classes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, class_id (the least doc_id that links reach, itself included) and n_links (the other documents of the class)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = stored(links(src, length), "passage-links")
    release(docs.sparkSession)
    comp = stored(components(edges), "passage-classes")
    sizes = comp.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    named = comp.join(sizes, "component").withColumnRenamed("node", "doc_id")
    return src.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
