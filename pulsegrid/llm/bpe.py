"""BPE encoding and decoding with a memory-mapped transducer of frequent words.

Words are runs without white space, with the one space before them, as the byte-level pre-tokenizer never
joins anything across them otherwise. The most frequent words of the corpus (counted over all of it, cut at ``size``)
are compiled into a minimal acyclic automaton: common suffixes share states, and arc outputs sum to
a word's number, which leads to its ids. The file goes to every executor with the job and is
memory-mapped there. Words that the transducer lacks are split by the vocabulary's pattern and
merged exactly, pair by pair, in rank order.

Defined results: null texts count as empty (no ids); special tokens written out in a text are matched as such,
before anything else; decoding replaces bytes that are no UTF-8.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import os
import re
import uuid
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from pulsegrid.llm.common import put, runs, stored

# Unicode's White_Space, which the pre-tokenizer's \s stands for.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SIZE = 65536
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
# Letters with marks of Latin-1, which are composed already; words of these and printable ASCII are split together.
MARKED = "À-ÖØ-öø-ÿ"
_PLAIN = f"^ ?[!-~{MARKED}]+$"
_PIECES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{MARKED}]+| ?[0-9]+| ?[^\sA-Za-z0-9{MARKED}]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        model = found["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (r, self.ids[raw(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.table: list[bytes] = [b""] * (1 + max(*self.ids.values(), *self.special.values()))
        for b, i in self.ids.items():
            self.table[i] = b
        for s, i in self.special.items():
            self.table[i] = s.encode()
        self.written = list(map(str, range(len(self.table))))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        self.slots, self.first = table_of(self.ranks), np.array(self.single, np.int64)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, count = merge_pairs(self.slots, self.first[np.frombuffer(b"".join(pieces), np.uint8)], size)
        flat, ends = ids.tolist(), np.cumsum(count).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def spell(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has. Plain words are split together, in one pass over all of them; newlines part them."""
        plain = pc.match_substring_regex(chunks, _PLAIN)
        simple, other = chunks.filter(plain).to_pylist(), chunks.filter(pc.invert(plain)).to_pylist()
        pieces = [_PIECES.findall("\n".join(simple)), *map(self.pattern.findall, other)]
        codes, distinct = numbered(list(chain.from_iterable(pieces)))
        raw = [p.encode() for p in distinct.to_pylist()]
        flat, size = merge_pairs(self.slots, self.first[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw)))
        mark = pc.index(distinct, "\n").as_py() if simple else -1  # of the words that are not plain none but "\n" itself holds one
        n = len(pieces[0])
        cut = np.r_[-1, np.flatnonzero(codes[:n] == mark), n] if simple else np.zeros(1, np.int64)
        first, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        first[plain], count[plain] = cut[:-1] + 1, np.diff(cut) - 1
        sizes = np.array([len(x) for x in pieces[1:]], np.int64)
        first[~plain], count[~plain] = n + np.cumsum(sizes) - sizes, sizes
        entries = codes[laid(first, count, np.arange(len(chunks)))]
        upto = np.r_[0, np.cumsum(size[codes])]
        return flat[laid(np.cumsum(size) - size, size, entries)], upto[first + count] - upto[first]

    def words(self, chunks: list[str]) -> list[list[int]]:
        """The ids of words."""
        if not chunks:
            return []
        flat, size = self.spell(pa.array(chunks, pa.string()))
        flat, ends = flat.tolist(), np.cumsum(size).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def numbered(words: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers, and the distinct words by number."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def laid(start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the stretches ``which`` one after the other."""
    n = size[which]
    return np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


_PROBES = 64


def merge_pairs(slots: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged ids of pieces that begin as ``size`` ids each, end to end, and how many each has.

    Pairs of lowest rank first, leftmost among equals; all pieces advance together, a rank a round. A pair that arises
    from a merge always ranks after it, so a piece's pairs of its lowest rank can be merged in one round.
    """
    keys, ranks, made = slots
    none, mask = np.iinfo(np.int32).max, len(keys) - 1
    piece, ids = np.repeat(np.arange(len(size), dtype=np.int32), size), ids.astype(np.int32)
    if not len(ids):
        return ids.astype(np.int64), np.zeros(len(size), np.int64)

    def look(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of the pairs that begin at ``p``."""
        key = ids[p].astype(np.int64) << 17 | ids[p + 1]
        at = (key * 0x9E3779B1 >> 13) & mask
        found = keys[at]
        miss = np.flatnonzero((found != key) & (found >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & mask
            found[miss] = here = keys[at[miss]]
            miss = miss[(here != key[miss]) & (here >= 0)]
        return np.where((piece[p] == piece[p + 1]) & (found == key), ranks[at], none), at

    rank, slot = np.full(len(ids), none, np.int32), np.zeros(len(ids), np.int32)
    p = np.arange(len(ids) - 1)
    rank[:-1], slot[:-1] = look(p)
    pieces, found_ids = [], []
    while len(ids):
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        count = np.diff(np.r_[starts, len(ids)])
        least = np.minimum.reduceat(rank, starts)
        keep = np.repeat(least < none, count)
        if not keep.all():
            pieces.append(piece[~keep])
            found_ids.append(ids[~keep])
        mark = rank == np.repeat(np.where(least < none, least, -1), count)
        if (mark[1:] & mark[:-1]).any():  # of pairs that overlap in a run, every second
            first = mark & ~np.r_[False, mark[:-1]]
            run = np.flatnonzero(first)[np.maximum(np.cumsum(first) - 1, 0)]
            mark &= (np.arange(len(ids)) - run) % 2 == 0
        hit = np.flatnonzero(mark)
        ids[hit] = made[slot[hit]]
        keep[hit + 1] = False
        place = np.cumsum(keep)[hit] - 1  # of what was merged, once the rest has gone
        ids, piece, rank, slot = ids[keep], piece[keep], rank[keep], slot[keep]
        if not len(ids):
            break
        # only pairs with something new need another look
        new = np.zeros(len(ids) + 1, bool)
        new[place] = new[place - 1] = True  # before the first: the one past the last
        rank[-1] = none
        p = np.flatnonzero(new[: len(ids) - 1])
        rank[p], slot[p] = look(p)
    piece = np.concatenate(pieces)
    return np.concatenate(found_ids)[np.argsort(piece, kind="stable")].astype(np.int64), np.bincount(piece, minlength=len(size))


def table_of(ranks: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An open-addressing table of pairs: key (-1: free), rank, merged id."""
    size = 1 << max(4, (8 * len(ranks)).bit_length())
    keys, rank, made = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)
    for (a, b), (r, m) in ranks.items():
        key = a << 17 | b
        at = ((key * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF) >> 13) & (size - 1)
        steps = 0
        while keys[at] >= 0:
            at, steps = (at + 1) & (size - 1), steps + 1
            if steps >= _PROBES:
                raise ValueError("a pair is too far from its place")
        keys[at], rank[at], made[at] = key, r, m
    return keys, rank, made


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(text: str, special: re.Pattern | None = None) -> list[str]:
    """The words of a text; special tokens are words of their own."""
    if special is None or not special.search(text):
        return _CHUNK.findall(text)
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else _CHUNK.findall(part)
    return out


# --- the transducer -------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the keys, built in sorted order, states registered from the longest suffix up.

    File: 6 lengths, then arc keys (state << 8 | byte, sorted), arc targets, arc outputs, final flags by
    state, id offsets by word number, ids; all little-endian int64 or int32 arrays.
    """
    keys = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, child) not yet minimised

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            same = (final[child], tuple(arcs[child].items()))
            arcs[state][byte] = register.setdefault(same, child)

    last = b""
    for key in keys:
        depth = len(os.path.commonprefix([last, key]))
        settle(depth)
        state = path[-1][2] if path else 0
        for byte in key[depth:]:
            arcs.append({})
            final.append(False)
            child = len(arcs) - 1
            arcs[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = key
    settle(0)
    order, number = [0], {0: 0}
    for s in order:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    todo = [(0, False)]
    while todo:  # words reachable from each state, children first
        s, ready = todo.pop()
        if s in below:
            continue
        if ready:
            below[s] = int(final[s]) + sum(below[t] for t in arcs[s].values())
        else:
            todo += [(s, True), *((t, False) for t in arcs[s].values() if t not in below)]
    rows = []
    for s in order:
        before = int(final[s])
        for byte, t in sorted(arcs[s].items()):
            rows.append((number[s] << 8 | byte, number[t], before))
            before += below[t]
    table = np.array(rows, np.int64).reshape(-1, 3)
    ids = [entries[k] for k in keys]
    parts = [
        table[:, 0].astype("<i8"), table[:, 1].astype("<i4"), table[:, 2].astype("<i4"), np.array([final[s] for s in order], "<i4"),
        np.cumsum([0, *map(len, ids)]).astype("<i4"), np.array([i for x in ids for i in x], "<i4"),
    ]
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, "<i8", 6)
        at, parts = 48, []
        for n, kind in zip(sizes.tolist(), ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4"), strict=True):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += n * int(kind[2])
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = parts

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, or -1: all keys walk the automaton together, a byte a step."""
        n = len(keys)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            if n and len(self.final) and self.final[0]:
                out[[not k for k in keys]] = 0
            return out
        sizes = np.fromiter(map(len, keys), np.int64, n)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        starts = np.cumsum(sizes) - sizes
        live, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(live):
            done = sizes[live] == step
            ended = done & (self.final[state] == 1)
            out[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
            want = state << 8 | flat[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            live, arc = live[hit], arc[hit]
            state, total = self.targets[arc].astype(np.int64), total[hit] + self.outputs[arc]
            step += 1
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


@functools.lru_cache(2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


# --- on Spark --------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """word (UTF-8 bytes) and how often it occurs in all texts; counted in part before the shuffle."""

    def run(batches):
        cut, counts = vocabulary(vocab_path).cut, Counter()

        def rows():
            found = iter(counts.items())
            while some := list(islice(found, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in runs(batch, 0):
                for text in part.column(0):
                    if t := text.as_py():
                        counts.update(words(t, cut))
                if len(counts) > 400_000:
                    yield from rows()
                    counts.clear()
        yield from rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_lexicon(docs: DataFrame, vocab_path: str, size: int = SIZE) -> str:
    """Counts words, compiles the most frequent, ``size`` at most, and writes the file in the shared folder, from where executors fetch it; returns its name."""
    vocab = vocabulary(vocab_path)
    counts = stored(word_counts(docs, vocab_path), "bpe-words")
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # 16 per doubling of n
    total, cut = 0, None
    for r in steps:
        total += r["words"]
        if total > size:
            break
        cut = r["level"]
    top = counts.filter(level >= cut).select("word").collect() if cut is not None else []  # at most size words
    found = sorted(w for r in top if (w := bytes(r["word"]).decode()) not in vocab.special)
    entries = dict(zip((w.encode() for w in found), vocab.words(found), strict=True))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    docs.sparkSession.sparkContext.addFile(put(docs.sparkSession, name, compile_lexicon(entries)))
    return name


class Encoder:
    """Texts to ids, in arrays: distinct words of a batch are looked up together, and those that the lexicon lacks are merged together."""

    def __init__(self, vocab: Vocabulary, lex: Lexicon | None):
        self.vocab, self.lex = vocab, lex

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        split = [words(t, self.vocab.cut) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes, distinct = numbered(list(chain.from_iterable(split)))
        del split
        start, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        known = np.zeros(len(distinct), bool)
        flat = [np.zeros(0, np.int64)]
        if self.lex:
            number = self.lex.numbers([w.encode() for w in distinct.to_pylist()])
            known = number >= 0
            start[known], count[known] = self.lex.offsets[number[known]], np.diff(self.lex.offsets)[number[known]]
            flat[0] = self.lex.ids.astype(np.int64)
        at = len(flat[0])
        for word, i in self.vocab.special.items():
            if (place := pc.index(distinct, word).as_py()) >= 0:
                start[place], count[place], known[place] = at, 1, True
                flat.append(np.array([i]))
                at += 1
        if not known.all():
            merged, count[~known] = self.vocab.spell(distinct.filter(pa.array(~known)))
            start[~known] = at + np.cumsum(count[~known]) - count[~known]
            flat.append(merged)
        upto = np.r_[0, np.cumsum(count[codes])]
        ends = np.cumsum(sizes)
        return np.concatenate(flat)[laid(start, count, codes)], upto[ends] - upto[ends - sizes]


def encode(docs: DataFrame, vocab_path: str, lexicon_file: str | None = None) -> DataFrame:
    """Replaces ``text`` by ``ids``; other columns pass through."""
    keep = [c for c in docs.columns if c not in ("text", "ids")]
    src = docs.select(*keep, "text")
    schema = StructType([*src.drop("text").schema.fields]).add("ids", ArrayType(LongType()))

    def run(batches):
        enc = Encoder(vocabulary(vocab_path), lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)
        for batch in batches:
            for part in runs(batch, len(keep)):
                ids, sizes = enc([t or "" for t in part.column(len(keep)).to_pylist()])
                rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], names=schema.names)

    return src.mapInArrow(run, schema)


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    return b"".join(map(vocab.table.__getitem__, ids)).decode("utf-8", "replace")


def decode(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """Replaces ``ids`` by ``text``; other columns pass through."""
    keep = [c for c in tokens.columns if c not in ("text", "ids")]
    src = tokens.select(*keep, "ids")
    schema = StructType([*src.drop("ids").schema.fields]).add("text", StringType())

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [decode_ids(x or [], vocab) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str, lexicon_file: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ``text``: ids and decoded texts are never held for more than one document."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")]
    src = docs.select(*keep, "text")
    schema = StructType([*src.drop("text").schema.fields]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def run(batches):
        vocab = vocabulary(vocab_path)
        enc = Encoder(vocab, lexicon(SparkFiles.get(lexicon_file)))
        for batch in batches:
            for part in runs(batch, len(keep)):
                a, b = [], []
                ids, sizes = enc([t or "" for t in part.column(len(keep)).to_pylist()])
                flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
                for i, j in zip([0, *ends], ends, strict=False):
                    doc = flat[i:j]
                    a.append(hashlib.sha256(",".join(map(vocab.written.__getitem__, doc)).encode()).hexdigest())
                    b.append(hashlib.sha256(decode_ids(doc, vocab).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
