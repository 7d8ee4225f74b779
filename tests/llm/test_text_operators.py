import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, components, katz, quality, rangecoder, simhash, suffix, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, a hot passage, nulls, empties and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared, hot = prose(70), prose(55)
    texts = [prose(rng.randint(1, 150)) for _ in range(n)]
    texts += [texts[0], texts[1] + " tail", prose(20) + " " + shared + " " + prose(30), shared, "x\n" + shared.upper(), None, "", "   \n", prose(3000), "a", "😀" * 90, "ab" * 400]
    texts += [prose(8) + " " + hot + " " + prose(8) for _ in range(25)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id " * 60, None, None, 360), (0, texts[0], "en", "s0", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 80)] + [(200, j) for j in range(201, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(5, 5), (3, 2)]
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for v in y:
                label[v] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b and len(label[a]) == 1}
    assert got == {v: min(s) for v, s in label.items() if v not in loops}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_brute_force(spark, docs):
    def fp(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        votes = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in sh) for i in range(64)]
        return sum(1 << i for i in range(64) if sh and 2 * votes[i] > len(sh))

    rows = docs.collect()
    want = [fp(r.text) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, f) for r, f in zip(rows, want, strict=True))
    near = defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (want[a] ^ want[b]).bit_count() <= 3:
            near[a].add(b)
            near[b].add(a)
    for i, r in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        ids = [rows[j].doc_id for j in reach if rows[j].doc_id is not None]
        mine = [g.component_id for g in got if g.doc_id == r.doc_id and g.fp % 2**64 == want[i]]
        assert set(mine) == {min(ids)} if ids else mine == [None] or set(mine) <= {None}


def test_forest_of_a_large_group():
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([np.full(3000, 12345, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)), rng.integers(0, 2**63, 500).astype(np.uint64)]))

    def classes(edges):
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                assert (x ^ y).bit_count() <= 3
                root[find(x)] = find(y)
        return len({find(int(x)) for x in fps})

    assert len(fps) > 2048
    fast = simhash._forest(fps, 3)
    assert classes(fast) == classes(simhash._spread(fps, 3)) and sum(len(a) for a, _ in fast) < 8 * len(fps)


def brute_spans(raw, length=200):
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(mark)
    return out


def test_suffix_dedup_against_brute_force(spark, docs):
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    want = []
    for r, b, m in zip(rows, raw, brute_spans(raw), strict=True):
        runs = sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1]))
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        want.append((r.doc_id is None, r.doc_id or 0, len(b), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 5000


def test_suffix_dedup_periodic_and_small(spark):
    texts = ["z" * 199, "z" * 200, "q" * 1000, "ab" * 150, "ab" * 99, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.removed(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1000, 3: 300, 4: 0, 5: 0, 6: 0}
    assert suffix.removed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.removed(df, 100)


def test_suffix_stage_keeps_rows_and_columns(spark, docs):
    out = suffix.deduped(docs.withColumn("extra", F.lit(1)))
    assert out.columns == [*docs.columns, "extra"] and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.filter("text IS NOT NULL").collect())
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()


def katz_by_loops(rows, train):
    toks = [(r.text or "").encode().lower().split() + ["</s>"] for r in rows]
    use = [t for t, f in zip(toks, train, strict=True) if f]
    c1 = Counter(w for t in use for w in t)
    c2 = Counter(p for t in use for p in zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c1.values()), len(c1)
    of = lambda c: np.array([sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)])
    d1, d2 = katz.discounts(of(c1)), katz.discounts(of(c2))
    cut = lambda d, r: d[r - 1] if r <= katz.K else 1.0
    kept = sum(cut(d1, x) * x for x in c1.values())
    total = n if kept < n - 1e-9 else n + 1
    word = lambda w: cut(d1, c1[w]) * c1[w] / total if w in c1 else (total - kept) / total
    after = defaultdict(dict)
    for (a, b), x in c2.items():
        after[a][b] = x
    params = {}
    for a, x in after.items():
        c, k = sum(x.values()), sum(cut(d2, y) * y for y in x.values())
        d = c if k < c - 1e-9 else c + 1
        params[a] = d, (1 - k / d) / (1 - sum(map(word, x)))

    def p(a, b):
        if a not in after:
            return word(b)
        return cut(d2, after[a][b]) * after[a][b] / params[a][0] if b in after[a] else params[a][1] * word(b)

    score = [sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t[:-1]], t, strict=True)) for t in toks]
    base = [sum(math.log10((c1.get(w, 0) + 1) / (n + v + 1)) for w in t) for t in toks]
    return toks, c1, n, score, base, p, after


def test_katz_against_loops_and_normalised(spark, docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)  # several blocks, and contexts that are split
    rows = docs.filter("doc_id IS NOT NULL").collect()
    train = [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    toks, c1, n, score, base, p, after = katz_by_loops(rows, train)
    got = katz.score(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), quality.fold_of(folds=7) != 2).collect()
    want = sorted((r.doc_id, len(t), sum(w in c1 for w in t), n, round(b, 6), round(s, 6)) for r, t, b, s in zip(rows, toks, base, score, strict=True))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    for a in ["<s>", *list(after)[:20]]:
        assert sum(p(a, w) for w in c1) + p(a, "no such word") == pytest.approx(1, abs=1e-9)


def test_katz_without_training_or_rows(spark, docs):
    out = katz.score(docs.select("doc_id", "text"), F.lit(False)).collect()
    assert len(out) == docs.count() and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in out)
    assert katz.score(docs.select("doc_id", "text").limit(0), F.lit(True)).count() == 0


def test_discounts():
    d = katz.discounts(np.array([1000, 400, 220, 140, 100, 75]))
    assert ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all()
    assert (katz.discounts(np.zeros(6)) == 1).all() and (katz.discounts(np.array([5, 0, 0, 0, 0, 9])) > 0).all()


BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
ALPHABET = [*"aAbe'sstdll 1٣Ⅷ½é̈ßİ漢😀\t\n\r\x0b\x1c\x1d\x85\xa0 　​̀.,!?-_\x00", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "'ll", "'re"]


def strings(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_bpe_equals_the_library(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    rows = [(i, s) for i, s in enumerate(strings(300))] + [(1000 + i, r.text) for i, r in enumerate(docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    name = bpe.train_lexicon(df, BYTE, 500)
    want = {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    for lexicon in (name, None):
        got = bpe.encode(df, BYTE, lexicon)
        assert {r.doc_id: list(r.ids) for r in got.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode(got, BYTE).collect()} == {d: t or "" for d, t in rows}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, BYTE, name).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {d: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for d, x in want.items()}


def test_lexicon_maps_words_to_ids_and_shares_suffixes(tmp_path):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() + rng.choice([b"", b"ing", b"ation"]): [rng.randint(0, 99) for _ in range(rng.randint(0, 4))] for _ in range(400)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words))
    lex = bpe.Lexicon(str(path))
    keys = list(words)
    numbers = lex.numbers(keys).tolist()
    assert sorted(numbers) == list(range(len(words)))
    assert [lex.ids_of(n) for n in numbers] == [words[k] for k in keys]
    assert lex.numbers([b"zz", b"aaing!", b"abababababababab"]).tolist() == [-1, -1, -1]
    assert len(lex.final) < sum(map(len, words)) / 3
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).numbers([b"a", b""]).tolist() == [-1, -1]


def test_word_encoder_equals_the_library(spark, docs):
    lib = Tokenizer.from_file(WORD)
    odd = ["A<|endoftext|>b <|ENDOFTEXT|> it's we'll 'TIS x'Sam", "É é \u212a I\u0307 \x1c\x85 \u00a0z \u200bq", "12345 a1b2 --- ...!? 'a ''s", " ", "\n", "日本語 テスト x日y", "🙂🙂 q\u0301 e\u0301", "aaaa aaaaaaaaaaaa 'll'll've"]
    texts = [r.text for r in docs.collect()] + odd + ["word " * 3000, None, *strings(2000, 6)]
    enc = rangecoder.WordEncoder(WORD)
    for part in (texts[:40], texts[40:], texts[:3], [None], [""], [], ["é"], ["日"]):
        ids, n = enc(pa.array(part, pa.string()), 2)
        want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in part]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 2047, 2048, 2049, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, rangecoder.NONE, n), rng.zipf(1.3, n) % 40_000, np.zeros(n), np.tile(rng.integers(0, 40_000, 50), n // 50 + 1)[:n]):
        for size in (2048, 500):
            coded = rangecoder.write_file([1, 2], [n, 0], ids.astype(np.uint32), size)
            names, sizes, got = rangecoder.read_file(coded)
            assert names == [1, 2] and sizes.tolist() == [n, 0] and (got == ids).all()
            if n == 9000 and len(set(ids.tolist())) < 60:
                assert len(coded) < n / 2


def test_carries_run_through(monkeypatch):
    """Blocks of ids that are as likely as can be, so that words are full of ones."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        ids = np.where(rng.random(20_000) < 0.999, 7, rng.integers(0, 60_000, 20_000)).astype(np.uint32)
        assert (rangecoder.read_file(rangecoder.write_file([0], [len(ids)], ids, 1000))[2] == ids).all()


def test_the_mixed_model_is_smaller_than_order_0_and_zlib():
    texts = [r[0] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pandas().itertuples(index=False)]
    ids, _ = rangecoder.WordEncoder(WORD)(pa.array(texts), 2)
    size = 8 * len(rangecoder.write_file([0], [len(ids)], ids)) / len(ids)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    block = rangecoder.IDS
    packed = sum(len(zlib.compress(ids[i : i + block].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), block)) * 8 / len(ids)
    assert size < -(p * np.log2(p)).sum() < packed


def test_token_files_detect_damage():
    b = rangecoder.write_file([3, None], [2, 1], np.array([5, 6, 2]))
    names, sizes, found = rangecoder.read_file(b)
    assert names == [3, None] and sizes.tolist() == [2, 1] and found.tolist() == [5, 6, 2]
    broken = bytearray(b)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.read_file(bytes(broken))
    with pytest.raises(ValueError):
        rangecoder.write_file([1], [1], np.array([rangecoder.NONE]))


@pytest.mark.parametrize("size", [4000, 300])
def test_token_files_on_spark(spark, docs, size):
    lib = Tokenizer.from_file(WORD)
    files = rangecoder.write_tokens(docs, WORD, file_bytes=size)
    got = rangecoder.read_tokens(files).collect()
    of = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, signed(of(r.text))))
    at, want = 0, []
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert rangecoder.write_tokens(docs.limit(0), WORD).count() == 0


def test_a_range_streams_into_files(spark):
    """All rows have one doc_id, so that one range has them all."""
    df = spark.createDataFrame([(None, f"text {i} " * 40) for i in range(60)], "doc_id long, text string").coalesce(1)
    files = rangecoder.write_tokens(df.withColumn("text", F.lit("same words " * 40)), WORD, file_bytes=2000)
    got = sorted(rangecoder.read_tokens(files).collect(), key=lambda r: r.start)
    assert files.count() > 5 and [r.start for r in got] == [81 * i for i in range(60)] and {r.n_tokens for r in got} == {81}


def test_compact_windows_are_tree_nodes():
    rng = np.random.default_rng(8)
    ends = np.array([30, 30, 95, 100])
    h = rng.integers(0, 50, 100).astype(np.uint64) << np.uint64(40)
    c, l, r = windows.compact_windows(h, ends, 10)
    want = []
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        for i in range(lo, hi):
            a = i
            while a > lo and h[a - 1] > h[i]:
                a -= 1
            b = i
            while b + 1 < hi and h[b + 1] >= h[i]:
                b += 1
            if b - a + 1 >= 10:
                want.append((i, a, b))
    assert sorted(zip(c.tolist(), l.tolist(), r.tolist(), strict=True)) == want


def test_passages_repeated_verbatim_share_a_class(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    got = {r.doc_id: (r.class_id, r.n_links) for r in windows.passage_classes(docs).collect()}
    seen = defaultdict(set)
    for r in rows:
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(r.doc_id)
    groups = [g for g in seen.values() if len(g) > 1]
    assert len(groups) > 10 and all(len({got[d][0] for d in g}) == 1 for g in groups)
    linked = {d for g in groups for d in g}
    assert {d for d, (_, n) in got.items() if n} == linked and all(got[d] == (d, 0) for d in got if d is not None and d not in linked)
    assert got[None] == (None, 0) and windows.passage_classes(docs.limit(0)).count() == 0


def test_passages_with_edits_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        passage = [word() for _ in range(220)]
        other = passage[:]
        other[60] = other[150] = "changed"
        rows += [(2 * i, " ".join([word() for _ in range(20)] + passage)), (2 * i + 1, " ".join(other + [word() for _ in range(9)]))]
    got = {r.doc_id: r.class_id for r in windows.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(40))


def test_quality_learns_and_calibrates(spark):
    rng = random.Random(10)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "!!!", "$$$", "WIN"]) for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)] + [(900, None, 1), (901, "", 0), (902, good(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    train = df.filter(quality.fold_of() != 0)
    model = quality.fit(df.drop("quality"), train.select("doc_id", "quality"))
    out = quality.score(df.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 303 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and all(r.predicted == r.quality for r in held)
    again = quality.fit(df.drop("quality"), train.select("doc_id", "quality"))
    assert {r.doc_id: r.score for r in out} == {r.doc_id: r.score for r in quality.score(df, again).collect()}


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(df, quality.fit(df, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert [r.score for r in quality.score(df, quality.fit(df, one)).collect()] == [1.0, 1.0]
    assert quality.score(df.limit(0), quality.fit(df.limit(0), one)).count() == 0


def test_isotonic_is_nondecreasing():
    x, y = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus(3, 120) if r[1] and r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 7 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{i}"))
        assert i == 4 or docs.columns == columns
        assert docs.count() > 0 and docs.select("doc_id").exceptAll(before.select("doc_id")).count() <= before.count()
    lib = Tokenizer.from_file(BYTE)
    texts = {(r.doc_id, r.text) for r in before.collect()}
    assert {(r.doc_id, lib.decode(list(r.ids), skip_special_tokens=False)) for r in docs.collect()} == texts
