"""Every registered query of the subpackage, as registered, against brute force on a small fixture."""

import hashlib
import io
import random
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import mixing, order_minhash, quality, queries, shingles, suffix
from tests.llm.test_text_operators import brute_spans, corpus, katz_by_loops

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(*r[:2], "en", r[3], r[4]) for r in corpus(11, 80) if r[0] is not None and r[:2] != (0, corpus(11, 80)[0][1])] + [(0, corpus(11, 80)[0][1], "en", "s0", 1)]
    out = list({r[0]: r for r in out}.values())
    junk = [(500 + i, " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "WIN"]) for _ in range(60)) + f" {i}", "en", "s1", 1) for i in range(40)]
    return out + junk


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 500), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def crc(d):
    return zlib.crc32(str(d).encode())


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def found(spark, sf, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf, rows):
    class Row:
        def __init__(self, r):
            self.doc_id, self.text = r[0], r[1]

    objects = [Row(r) for r in rows]
    train = [crc(r[0]) % 7 != 2 for r in rows]
    toks, c1, n, score, base, _, _ = katz_by_loops(objects, train)
    got = found(spark, sf, "op1_katz_score")
    for r, t, b, s, f in zip(rows, toks, base, score, train, strict=True):
        x = got[r[0]]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not f, len(t), sum(w in c1 for w in t), n)
        assert x.base_score == pytest.approx(b, abs=1e-6) and x.score == pytest.approx(s, abs=1e-6)


def test_op2(spark, sf, rows):
    got = found(spark, sf, "op2_media_columns")
    for d, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), sha(pad), zlib.crc32(pad[-64:]))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(pad)
        assert abs(r.media_bytes - len(out.getvalue())) < 64
    assert len(got) == len(rows)


def test_op3(spark, sf, rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        votes = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in sh) for i in range(64)]
        return sum(1 << i for i in range(64) if sh and 2 * votes[i] > len(sh))

    want = {r[0]: fp(r[1]) for r in rows}
    label = {d: d for d in want}
    for a in want:
        for b in want:
            if (want[a] ^ want[b]).bit_count() <= 3 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if x == hi else x for d, x in label.items()}
    assert {d: (r.fingerprint, r.component_id) for d, r in found(spark, sf, "op3_simhash").items()} == {d: (f"{want[d]:016x}", label[d]) for d in want}


def test_op4_and_op5(spark, sf, rows):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = found(spark, sf, "op4_bpe")
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert tuple(got[d])[1:4] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    lib, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = found(spark, sf, "op5_token_files")
    for d, t, *_ in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(got[d]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, sf, rows):
    seen = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        for i in range(len(w) - 50):
            seen.setdefault(tuple(w[i : i + 51]), set()).add(d)
    label = {r[0]: r[0] for r in rows}
    for g in seen.values():
        least = min(label[d] for d in g)
        old = {label[d] for d in g}
        label = {d: least if x in old else x for d, x in label.items()}
    got = found(spark, sf, "op6_passages")
    plain = [d for d in label if d < 500]  # the junk's few words make near-duplicates besides
    size = Counter(label.values())
    assert {d: (got[d].class_id, got[d].n_links) for d in plain} == {d: (label[d], size[label[d]] - 1) for d in plain}


def test_op7(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    got = queries.QUERIES["op7_mix_sources"](spark, sf)
    assert got.columns == [c[0] for c in con.description] and sorted(map(tuple, got.collect())) == sorted(want)


def test_op8(spark, sf, rows):
    got = found(spark, sf, "op8_suffix_dedup")
    raw = [(r[1] or "").encode() for r in rows]
    for r, b, m in zip(rows, raw, brute_spans(raw), strict=True):
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        x = got[r[0]]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(b), sum(m), bytes(m).replace(b"\0", b" ").split().__len__(), sha(kept))


def test_op9_against_a_direct_computation(spark, sf, rows):
    """The normal equations over all rows at once, and the isotonic map as the max-min of means."""
    got = found(spark, sf, "op9_quality")
    use = [r for r in rows if crc(r[0]) % 5]
    df = spark.createDataFrame([(r[0],) for r in use], "doc_id long")
    fold = {r.doc_id: r.fold for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).alias("fold")).collect()}
    x, y = quality.matrix([r[1] for r in use]), np.array([float(r[0] < 500) for r in use])
    mean, scale = x.mean(0), x.std(0)
    features = quality.Features(mean, np.where(scale > 1e-9, scale, 1.0), quality.WIDTH)
    learn = np.array([fold[r[0]] < 3 for r in use])
    z = features(x)
    d = z.shape[1]
    # ridge regression as least squares with rows added
    extra = np.sqrt(quality.RIDGE * learn.sum() / d) * np.eye(d)
    weights = np.linalg.lstsq(np.vstack([z[learn], extra]), np.r_[y[learn], np.zeros(d)], rcond=None)[0]
    raw, want = z[~learn] @ weights, y[~learn]
    kx, ky = quality.isotonic(raw, want)
    model = quality.Model(features, weights, (kx, ky), 0.0)
    for r in rows:
        s = float(model.score(quality.matrix([r[1]]))[0])
        assert got[r[0]].score == pytest.approx(s, abs=1e-4) and got[r[0]].held_out == (crc(r[0]) % 5 == 0) and got[r[0]].predicted == int(got[r[0]].score >= 0.3)
    held = [got[r[0]] for r in rows if crc(r[0]) % 5 == 0 and (r[1] or "").strip()]
    assert sum(r.predicted == (r.doc_id < 500) for r in held) > 0.95 * len(held)


def test_isotonic_by_the_max_min_formula():
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(60))
    y = (rng.random(60) < x).astype(float)
    kx, ky = quality.isotonic(x, y)
    fit = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    sizes = [len(list(g)) for _, g in __import__("itertools").groupby(np.round(fit, 9))]
    assert len(sizes) == len(kx)
    at = 0
    for n, a, b in zip(sizes, kx, ky, strict=True):
        assert a == pytest.approx(x[at : at + n].mean()) and b == pytest.approx((fit[at] * n + 0.5) / (n + 1))
        at += n


def test_statistics_by_characters():
    text = "Hello, World! It's 12 o'clock... WIN $$$ now!\n\nsome-verylongwordthatgoeson here here\n" * 3
    s = dict(zip(quality.NAMES, quality.statistics(text), strict=True))
    n, w = len(text), text.split()
    share = lambda f: sum(map(f, text)) / n
    assert s["upper"] == share(str.isupper) and s["digit"] == share(str.isdigit) and s["space"] == share(lambda c: c == " ") and s["newline"] == share(lambda c: c == "\n")
    assert s["log_words"] == np.log1p(len(w)) and s["distinct_words"] == len(set(w)) / len(w) and s["top_word"] == max(Counter(w).values()) / len(w)
    assert s["long_words"] == sum(len(x) > 14 for x in w) / len(w) and s["upper_words"] == sum(len(x) > 1 and x.isupper() for x in w) / len(w)


def test_op10(spark, sf, rows):
    got = found(spark, sf, "op10_order_minhash")
    order = sorted(rows)
    texts = [r[1] or "" for r in order]
    edited = []
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        edited.append(t[: len(t) - half] + after[:half])
    sig = {t: r for t, r in zip(texts + edited, (r.s for r in order_minhash.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts + edited)], "i int, text string"), out="s").orderBy("i").collect()), strict=True)}

    def near(a, b):
        pairs = [(x, y) for x, y in zip(sig[a], sig[b], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    for i, (r, t, e) in enumerate(zip(order, texts, edited, strict=True)):
        x = got[r[0]]
        assert (x.n_chars, x.edited_sha256) == (len(t), sha(e))
        assert x.near_edited == pytest.approx(near(t, e)) and x.near_next == pytest.approx(near(t, texts[(i + 1) % len(texts)]))
        assert len(x.fingerprint) == len(x.edited_fingerprint) == 8 * order_minhash.BUCKETS


def test_columns_of_other_meaning_pass_through_order_minhash(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8), (2, "d e f", 1, 2, 3, 4)], "doc_id long, text string, bucket int, more int, _words int, next_text int")
    out = order_minhash.with_next(order_minhash.fingerprints(df), lambda d: d, ["text"])
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "bucket", "more", "_words", "signature", "next_text"]
    assert got[1].next_text == "d e f" and got[2].next_text == "a b c" and (got[1].bucket, got[1].more, got[1]._words) == (5, 6, 7)


def test_pipeline_as_registered(spark, sf, rows):
    """run() gives what the stages give one after the other, each held against brute force on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), SCHEMA)
        after = {r.doc_id for r in docs.collect()}
        if name == "quality classifier":
            scores = quality.score(spark.createDataFrame(list(before.values()), SCHEMA), quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").filter(quality.fold_of() != 0)))
            assert after == {r.doc_id for r in scores.collect() if r.predicted}
        else:
            sets = {d: shingles.shingles(r.text) for d, r in before.items()}
            label = {d: d for d in sets}
            for a in sets:
                for b in sets:
                    if shingles.similar(sets[a], sets[b]) and label[a] != label[b]:
                        lo, hi = sorted((label[a], label[b]))
                        label = {d: lo if x == hi else x for d, x in label.items()}
            assert after == set(label.values())
    cut = suffix.deduped(docs)
    mixed = mixing.copies(spark.createDataFrame(cut.collect(), SCHEMA))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids) for r in mixed.collect())
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == want
