"""Token-id files by an adaptive context-mixing range coder.

Ids are cut into blocks that are coded independently, each from a fresh model and with checksums. Three predictions are
mixed for every id: order 2 and order 1 each expect the id that followed their context last in the block; order 0 is a distribution over
the file's ids, whose frequencies stand in the file's header, to a quarter of a power of two. The weights of orders 2 and 1 are
learned in the block, for each number of times that the expectation has held. The probability of an id is the weighted sum of all
three,

    P(s) = x2 [s = g2] + x1 [s = g1] + x0 P0(s),

and ids are coded by their interval in the cumulative sum, in the order of ids.

All blocks of a file advance together, one id a step, in numpy; encoder and decoder run the same model, in whole numbers.

File format, little-endian: magic ``PGTK``, version, ids per block, documents, blocks, distinct ids; doc_id (int64) and a null flag (uint8) and length
(int64) per document; the distinct ids (uint16), most frequent first, and a frequency level (uint8) of each; for each block its number of
ids, of 32-bit words, the CRC-32 of its ids as uint32 and of its words; then the words. Ids are below 65,535.

Defined results: null texts count as empty and have the end id alone; documents stand in ascending doc_id order, nulls
first, repeated ones in the order of a hash of their texts; an empty table gives no file.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm.bpe import MARKED, byte_letters, laid, merge_pairs, table_of
from pulsegrid.llm.common import runs, small, split_words, stored, text_bytes

MAGIC, VERSION, IDS, FILE_BYTES = b"PGTK", 2, 2048, 20_000_000
KNOWN = 1_000_000  # pieces of some 20 bytes each, with their ids
SLOTS1, SLOTS2, NONE = 1024, 2048, 65535  # entries of the context tables of a block; ids are below NONE
MIX, ZERO, RATE = 12, 16, 5  # bits of the weights and of order 0's distribution; how slowly weights are learned
_U = np.uint64
#: what an entry keeps above its id: how often the expectation held, after (times, held again?), at most three
_NEXT = np.array([1, 1, 1, 2, 1, 3, 1, 3], np.int32)
#: weights of 4096 at the start of a block; an empty entry has none
START2, START1, _HELD = (0, 1100, 2200, 3000), (0, 600, 1200, 1800), 4064


class _Zero:
    """Order 0: cumulative frequencies of dense codes out of 2**16; the code one past the last stands for no id and has none."""

    def __init__(self, levels: np.ndarray):
        n = len(levels)
        if n > 1 << ZERO:
            raise ValueError("too many distinct ids")
        level = levels.astype(np.int64)
        rough = np.array([16, 19, 23, 27])[level & 3] << (level >> 2)  # 16 x 2 ** (level / 4)
        f = 1 + rough * ((1 << ZERO) - n) // max(1, int(rough.sum()))
        if n:
            f[0] += (1 << ZERO) - int(f.sum())
        self.none = n
        f = np.r_[f, 0]
        self.f, self.c = f.astype(np.int32), (np.cumsum(f) - f).astype(np.int32)
        self.find = np.repeat(np.arange(n, dtype=np.int32), f[:-1])


def _levels(counts: np.ndarray) -> np.ndarray:
    """Four levels for each doubling; the largest counts of a file fit a byte as long as they are below 2**40."""
    return np.round(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


class _Model:
    """The state of all blocks of a file, a stretch of each array per block. Weights and intervals fit 32 bits."""

    def __init__(self, n: int, zero: _Zero):
        self.zero, row = zero, np.arange(n, dtype=np.int64)
        self.row1, self.row2, self.row4 = row * SLOTS1, row * SLOTS2, row * 4
        # an entry is an id and two bits above it, in 16 bits where all ids fit
        self.bits, kind = (14, np.uint16) if zero.none < 1 << 14 else (16, np.int32)
        self.low, self.next = (1 << self.bits) - 1, _NEXT << self.bits
        self.t1 = np.full(n * SLOTS1, zero.none, kind)
        self.t2 = np.full(n * SLOTS2, zero.none, kind)
        self.a1, self.a2 = np.tile(np.array(START1, np.int32), n), np.tile(np.array(START2, np.int32), n)
        self.p1 = self.p2 = np.zeros(n, np.int64)

    def shrink(self, n: int) -> None:
        self.row1, self.row2, self.row4, self.p1, self.p2 = (x[:n] for x in (self.row1, self.row2, self.row4, self.p1, self.p2))

    def guess(self) -> None:
        p1 = self.p1
        self.i1 = self.row1 + (p1 & (SLOTS1 - 1))
        self.i2 = self.row2 + ((p1 * 40503 + self.p2 * 10368889 >> 7) & (SLOTS2 - 1))
        e1, e2 = self.t1.take(self.i1).astype(np.int32), self.t2.take(self.i2).astype(np.int32)
        self.g1, self.g2, self.k1, self.k2 = e1 & self.low, e2 & self.low, e1 >> self.bits, e2 >> self.bits
        self.j1, self.j2 = self.row4 + self.k1, self.row4 + self.k2
        self.x2, self.own1 = self.a2.take(self.j2), self.a1.take(self.j1)
        left = (1 << MIX) - self.x2
        self.x1 = left * self.own1 >> MIX
        self.x0 = left - self.x1  # 1 at least, as no weight reaches all

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids' intervals out of 2**28."""
        x0, x1, x2, g1, g2 = self.x0, self.x1, self.x2, self.g1, self.g2
        t = s.astype(np.int32)
        self.hit1, self.hit2 = g1 == t, g2 == t
        start = x0 * self.zero.c.take(s) + (x2 * (g2 < t) + x1 * (g1 < t) << ZERO)
        return start.astype(_U), (x0 * self.zero.f.take(s) + (x2 * self.hit2 + x1 * self.hit1 << ZERO)).astype(_U)

    def at(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold ``v``: between the two expected ids only order 0 counts."""
        x0, zero = self.x0, self.zero
        first = self.g1 < self.g2
        lo, hi = np.minimum(self.g1, self.g2), np.maximum(self.g1, self.g2)
        w, w2 = np.where(first, self.x1, self.x2), np.where(first, self.x2, self.x1)
        same = lo == hi
        if same.any():
            w, w2, hi = w + w2 * same, w2 * ~same, np.where(same, zero.none, hi)
        w, w2 = w << ZERO, w2 << ZERO
        a = x0 * zero.c.take(lo)
        b = a + x0 * zero.f.take(lo) + w
        past = v >= b
        is_lo = (v >= a) & ~past
        v = v - w * past
        a = x0 * zero.c.take(hi)
        b = a + x0 * zero.f.take(hi) + w2
        past2 = past & (v >= b)
        is_hi = past & (v >= a) & ~past2
        v = v - w2 * past2
        q = np.minimum((v / x0).astype(np.int64), (1 << ZERO) - 1)  # exact: both are below 2**28
        return np.where(is_lo, lo, np.where(is_hi, hi, zero.find.take(q))).astype(np.int64)

    def learn(self, s: np.ndarray) -> None:
        self.a2[self.j2] = self.x2 + (self.hit2 * _HELD - self.x2 >> RATE)
        self.a1[self.j1] = self.own1 + (self.hit1 * _HELD - self.own1 >> RATE)
        self.t1[self.i1] = s | self.next.take(self.k1 * 2 + self.hit1)
        self.t2[self.i2] = s | self.next.take(self.k2 * 2 + self.hit2)
        self.p2, self.p1 = self.p1, s


def encode_blocks(codes: np.ndarray, levels: np.ndarray, size: int = IDS) -> list[tuple[int, np.ndarray]]:
    """(number of ids, words) of each block of dense codes."""
    blocks = -(-len(codes) // size)
    if not blocks:
        return []
    lengths = np.full(blocks, size)
    lengths[-1] = last = len(codes) - size * (blocks - 1)
    grid = np.zeros(blocks * size, np.uint16)
    grid[: len(codes)] = codes
    grid = np.ascontiguousarray(grid.reshape(blocks, size).T)
    m = _Model(blocks, _Zero(levels))
    width = size + 8
    out, k = np.zeros(blocks * width, np.uint32), np.arange(blocks) * width
    low, span = np.zeros(blocks, _U), np.full(blocks, 2**64 - 1, _U)
    n, one, bits, done = blocks, _U(1 << 32), _U(MIX + ZERO), None
    for t in range(size):
        if t == last:
            n = blocks - 1
            if not n:
                break
            done, low, span = low[-1:], low[:n], span[:n]
            m.shrink(n)
        s = grid[t, :n].astype(np.int64)
        m.guess()
        start, wide = m.interval(s)
        r = span >> bits
        new = low + r * start
        carry = new < low
        low, span = new, r * wide
        if carry.any():
            back = k[:n][carry] - 1
            while len(back):
                out[back] += np.uint32(1)
                back = back[out[back] == 0] - 1
        emit = span < one
        out[k[:n]] = low >> _U(32)  # stays only where k moves on
        k[:n] += emit
        shift = emit.astype(_U) << _U(5)
        low, span = low << shift, span << shift
        m.learn(s)
    if done is not None:
        low = np.r_[low, done]
    elif not n:
        low = low[:blocks]
    out[k], out[k + 1] = low >> _U(32), low & _U(0xFFFFFFFF)
    used = k - np.arange(blocks) * width + 2
    out = out.reshape(blocks, width)
    return [(int(a), out[i, :b]) for i, (a, b) in enumerate(zip(lengths.tolist(), used.tolist(), strict=True))]


def decode_blocks(lengths: np.ndarray, words: list[np.ndarray], levels: np.ndarray, size: int = IDS) -> np.ndarray:
    """The dense codes of blocks that all but the last have ``size`` ids."""
    blocks = len(lengths)
    if not blocks:
        return np.zeros(0, np.int64)
    width = max(map(len, words)) + 2
    src = np.zeros((blocks, width), np.uint32)
    for i, w in enumerate(words):
        src[i, : len(w)] = w
    src = src.ravel()
    m = _Model(blocks, _Zero(levels))
    k = np.arange(blocks) * width
    code = src[k].astype(_U) << _U(32) | src[k + 1]
    k += 2
    span, one, bits, most = np.full(blocks, 2**64 - 1, _U), _U(1 << 32), _U(MIX + ZERO), _U((1 << MIX + ZERO) - 1)
    out = np.zeros((size, blocks), np.uint16)
    n, last = blocks, int(lengths[-1])
    for t in range(size):
        if t == last:
            n = blocks - 1
            if not n:
                break
            code, span, k = code[:n], span[:n], k[:n]
            m.shrink(n)
        m.guess()
        r = span >> bits
        s = m.at(np.minimum(code // r, most).astype(np.int32))
        start, wide = m.interval(s)
        code, span = code - r * start, r * wide
        emit = span < one
        shift = emit.astype(_U) << _U(5)
        code = np.where(emit, code << _U(32) | src.take(k), code)
        span = span << shift
        k = k + emit
        m.learn(s)
        out[t, :n] = s
    return out.T.reshape(-1)[: size * (blocks - 1) + last].astype(np.int64)


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, size: int = IDS) -> bytes:
    """The file of documents of so many ids each, end to end in ``ids``."""
    ids = ids.astype("<u4")
    counts = np.bincount(ids, minlength=1)
    if len(counts) > NONE:
        raise ValueError(f"ids must be below {NONE}")
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    levels = _levels(counts[alphabet])
    dense = np.zeros(len(counts), np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    blocks = encode_blocks(dense[ids], levels, size)
    head = [MAGIC, struct.pack("<IIIII", VERSION, size, len(doc_ids), len(blocks), len(alphabet))]
    head += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<i8").tobytes()]
    head += [alphabet.astype("<u2").tobytes(), levels.tobytes()]
    table, body, at = [], [], 0
    for n, words in blocks:
        raw = words.astype("<u4").tobytes()
        table.append((n, len(words), zlib.crc32(ids[at : at + n].tobytes()), zlib.crc32(raw)))
        body.append(raw)
        at += n
    return b"".join([*head, np.array(table, "<u4").tobytes(), *body])


def read_file(b: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each document, the ids end to end); ValueError if a checksum fails."""
    version, size, docs, blocks, distinct = struct.unpack_from("<IIIII", b, 4)
    if b[:4] != MAGIC or version != VERSION:
        raise ValueError("not a token file")
    at = 24
    names = np.frombuffer(b, "<i8", docs, at).tolist()
    null = np.frombuffer(b, "u1", docs, at + 8 * docs).tolist()
    lengths = np.frombuffer(b, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    alphabet, levels = np.frombuffer(b, "<u2", distinct, at).astype("<u4"), np.frombuffer(b, "u1", distinct, at + 2 * distinct)
    at += 3 * distinct
    table = np.frombuffer(b, "<u4", 4 * blocks, at).reshape(blocks, 4)
    at += 16 * blocks
    words = []
    for _, n, _, crc in table.tolist():
        if zlib.crc32(b[at : at + 4 * n]) != crc:
            raise ValueError("a block's words fail their checksum")
        words.append(np.frombuffer(b, "<u4", n, at))
        at += 4 * n
    ids = alphabet[decode_blocks(table[:, 0].astype(np.int64), words, levels, size)] if blocks else np.zeros(0, "<u4")
    at = 0
    for n, _, crc, _ in table.tolist():
        if zlib.crc32(ids[at : at + n].tobytes()) != crc:
            raise ValueError("a block's ids fail their checksum")
        at += n
    return [None if z else d for d, z in zip(names, null, strict=True)], lengths, ids


_PLAIN = f"^[!-~{MARKED}]+$"
_LETTER, _DIGIT, _OTHER = 0, 1, 2
# What may follow an apostrophe as a piece with it.
_CLITICS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
WORD_END = "</w>"


@functools.lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split_pieces(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in lower-case plain words, which end at ``ends``.

    The vocabulary's pre-tokenizer in arrays: runs of letters, single digits, runs of anything else; an apostrophe that begins such a
    run is a piece with what follows it if that is one of the clitics.
    """
    n = len(raw)
    kind = np.full(256, _OTHER, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = _LETTER, _DIGIT, _LETTER  # marked letters have two high bytes
    k = kind[raw]
    first = np.zeros(n + 1, bool)
    first[np.r_[0, ends[:-1]]] = True
    new = first[:n] | np.r_[True, k[1:] != k[:-1]] | (k == _DIGIT)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)  # bytes of the word from here
    mark = np.flatnonzero(new & (raw == ord("'")))
    for clitic in _CLITICS:
        fits = mark[left[mark] > len(clitic)]
        for j, c in enumerate(clitic, 1):
            fits = fits[raw[fits + j] == c]
        new[fits + 1] = False
        after = fits + 1 + len(clitic)
        new[after[(after < n)]] = True
    return np.flatnonzero(new)


class WordEncoder:
    """The library's ids word by word: this vocabulary's rules never look across ASCII white space.

    Pieces of plain words are merged together in arrays, and kept, ``KNOWN`` of them or little more, for the next call; other words, and
    those that might hold a special token, go to the library.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a vocabulary with word ends is asked for")
        ids, letter = model["vocab"], byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.slots = table_of({(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)})
        self.inner = np.array([ids[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letter[b] + WORD_END] for b in range(256)], np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces among those met so far; new ones are merged."""
        if len(self.known) > KNOWN:
            self.known, self.flat, self.size = pieces[:0], self.flat[:0], self.size[:0]
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = place < 0
        fresh = pieces.filter(pa.array(new))
        size = pc.binary_length(fresh).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(fresh.buffers()[2] or b"", np.uint8)[: int(size.sum())]
        ids, last = self.inner[raw], np.cumsum(size) - 1
        ids[last] = self.last[raw[last]]
        ids, size = merge_pairs(self.slots, ids, size)
        place[new] = len(self.known) + np.arange(len(fresh))
        self.known, self.flat, self.size = pa.concat_arrays([self.known, fresh]), np.r_[self.flat, ids], np.r_[self.size, size]
        return place

    def __call__(self, texts: pa.Array | pa.ChunkedArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with ``end`` after it, and how many each text has."""
        codes, sizes, words = split_words(texts, lower=False)
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        simple, other = pc.utf8_lower(words.filter(plain)), words.filter(pc.invert(plain)).to_pylist()
        text = np.frombuffer(simple.buffers()[2] or b"", np.uint8)[: int(pc.sum(pc.binary_length(simple)).as_py() or 0)]
        ends = np.cumsum(pc.binary_length(simple).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = split_pieces(text, ends) if len(text) else np.zeros(0, np.int64)
        offsets = np.r_[starts, len(text)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))).dictionary_encode()
        pieces, distinct = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces.dictionary
        place = self._places(distinct)
        found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
        # entries: the distinct pieces, the library's words, the end; a word is a run of entries
        flat = np.concatenate([self.flat, *found, [end]])
        size = np.r_[self.size, np.array([len(x) for x in found], np.int64), 1]
        start = np.cumsum(size) - size
        place = np.r_[place, np.arange(len(self.size), len(size))]
        start, size = start[place], size[place]
        entries = np.r_[pieces, np.arange(len(distinct), len(size))]
        first, count = np.zeros(len(words) + 1, np.int64), np.ones(len(words) + 1, np.int64)
        plain = np.r_[plain.to_numpy(zero_copy_only=False), False]
        upto = np.searchsorted(starts, np.r_[0, ends])  # pieces before each word
        first[plain], count[plain] = upto[:-1], np.diff(upto)
        first[~plain] = len(pieces) + np.arange(len(other) + 1)
        sequence = np.insert(codes, np.cumsum(sizes), len(words))
        # the ids of each distinct word, then of all words
        upto = np.r_[0, np.cumsum(size[entries])]
        flat = flat[laid(start, size, entries[laid(first, count, np.arange(len(first)))])].astype(np.uint16)
        size = upto[first + count] - upto[first]
        ids = flat[laid(np.cumsum(size) - size, size, sequence)]
        upto = np.r_[0, np.cumsum(size[sequence])]
        return ids, np.diff(np.r_[0, upto[np.cumsum(sizes + 1)]])


_encoders: dict[str, WordEncoder] = {}


def write_tokens(docs: DataFrame, vocab_path: str, end: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """part, seq, start and content: token files in ascending doc_id order, each with the number of ids before it.

    Rows are sorted by range; each range is streamed into files of about ``file_bytes`` of text, however much it holds.
    """
    parts = max(1, -(-text_bytes(docs) // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("place").asc()]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        enc = _encoders.setdefault(vocab_path, WordEncoder(vocab_path))
        names, texts, held = [], [], 0

        def file():
            ids, lengths = enc(pa.chunked_array(texts, pa.string()), end)
            content = write_file(names, lengths.tolist(), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], names=["part", "seq", "n_ids", "content"])

        for batch in batches:
            for piece in runs(batch, 1, file_bytes // 8):
                names += piece.column(0).to_pylist()
                texts.append(piece.column(1))
                held += piece.column(1).nbytes
                if held > 1.5 * file_bytes:
                    yield file()
                    names, texts, held, seq = [], [], 0, seq + 1
        if names:
            yield file()

    made = stored(rows.mapInArrow(run, "part int, seq int, n_ids long, content binary"), "token-files")
    sizes = made.select("part", "seq", "n_ids")
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts_before = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", upto(Window.orderBy("part")).alias("before"))  # a row for each range
    starts = sizes.select("part", "seq", upto(Window.partitionBy("part").orderBy("seq")).alias("within")).join(parts_before, "part")
    starts = starts.select("part", "seq", (F.col("before") + F.col("within")).alias("start"))
    return made.join(small(starts, 10_000), ["part", "seq"]).select("part", "seq", "start", "content")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32, from the files' bytes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes, ids = read_file(batch.column(1)[i].as_py())
                before = np.cumsum(sizes) - sizes
                raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), (4 * np.r_[before, len(ids)]).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(batch.column(0)[i].as_py() + before), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("start", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
