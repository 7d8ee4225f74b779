import io
import struct
import wave
import zlib

import duckdb
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import media, mixing, order_minhash
from pulsegrid.llm.common import bucket_of, cut_points

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOCS = [
    (1, "a b c d", "en", "s1", 7), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, "x " * 500, "en", "s2", 1000), (5, "y z", "en", None, 3),
    (5, "y z", "en", None, 3), (None, "null id words here", "en", "s3", 18), (9, "w " * 3000, "en", "s1", 6000), (10, "v " * 100, "en", "s3", 200),
]


def test_buckets_keep_order(spark):
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)] + [(None,)], "doc_id long")
    cuts = cut_points(df, "doc_id", 100)
    rows = df.select("doc_id", bucket_of(F.col("doc_id"), cuts).alias("b")).collect()
    assert 8 <= len(cuts) <= 10
    for r in rows:
        assert r.b == (-1 if r.doc_id is None else sum(c <= r.doc_id for c in cuts))
    assert cut_points(df.limit(0), "doc_id", 100) == []


def test_mix_equals_sql_and_keeps_limits(spark, tmp_path):
    df = spark.createDataFrame(DOCS, SCHEMA)
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken", "shards")
    con = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:]))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
    assert all(r.taken <= 2 * r.size for r in got.collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.copies(df.limit(0)).count() == 0


def _mixed(n=300):
    return [(i, f"w{i} x\n" * 150, "en", f"s{i % 3}" if i % 3 else "s0", 600) for i in range(n)] + [(n, "tiny source", "en", "t", 11), (n + 1, " ", "en", "t", 1)]


def test_mix_meets_targets_of_small_sources_too(spark):
    taken, target = {}, {}
    for r in mixing.mix(spark.createDataFrame(_mixed(), SCHEMA), shard_slots=100).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 64 for s in taken) and abs(taken["t"] - target["t"]) <= 1


def test_shards_are_multinomial_and_make_the_mix(spark):
    per = mixing.targets(mixing.sizes(spark.createDataFrame(_mixed(), SCHEMA))).cache()
    slots = {r.src: r.slots for r in per.collect()}
    total = sum(slots.values())
    counts = mixing.shard_counts(per, shard_slots=100).collect()
    size = {}
    for r in counts:
        size[r.shard] = size.get(r.shard, 0) + r.slots
    shards = -(-total // 100)
    assert sorted(size) == list(range(shards)) and all(n == min(100, total - 100 * j) for j, n in size.items())
    for src, n in slots.items():  # variance of a binomial draw, not that of a plan
        got, p = [r.slots for r in counts if r.src == src and r.shard < shards - 1], n / total
        assert abs(sum(got) / len(got) - 100 * p) < 4 * (100 * p * (1 - p) / len(got)) ** 0.5 + 0.01
        if p > 0.05:
            spread = sum((x - 100 * p) ** 2 for x in got) / len(got)
            assert 0.4 < spread / (100 * p * (1 - p)) < 1.8
    drawn = mixing.draw(per, shard_slots=100).collect()
    assert len({(r.src, r.slot) for r in drawn}) == len(drawn) and {s: sum(r.src == s for r in drawn) for s in slots} == slots
    assert len({(r.src, r.turn, r.block) for r in drawn}) == len(drawn)
    dealt = {}
    for r in drawn:
        dealt[r.shard, r.src] = dealt.get((r.shard, r.src), 0) + 1
    assert sum(dealt.get((r.shard, r.src), 0) == r.slots for r in counts) > 0.8 * len(counts)


def test_permutations_of_any_size(spark):
    ns = [1, 2, 7, 1000, 2**31 - 1, 2**31 + 9, 6_000_000_011, mixing.PRIMES[1], mixing.PRIMES[2] * 3, 4 * 10**11]
    rows = [(n, slot, src) for n in ns for slot in {0, n - 1, n // 2, n, 2 * n - 1} for src in (0, 3)]
    df = spark.createDataFrame(rows, "n long, slot long, src long")
    turn, at = mixing.permuted(F.col("slot"), F.col("n"), F.col("src"), 1)
    for r in df.select("*", turn.alias("turn"), at.alias("at")).collect():
        primes = [mixing.PRIMES[(r.src + r.slot // r.n + 1 + k) % 4] for k in (0, 1)]
        a = primes[0] if r.n % primes[0] else primes[1]
        assert r.turn == r.slot // r.n and r.at == (a % r.n * (r.slot % r.n) + (r.src * 7919 + r.turn * 104729 + 15485863) % r.n) % r.n


def test_copies_are_the_blocks_that_the_mix_takes(spark):
    df = spark.createDataFrame([(*r, "c", 1) for r in _mixed(120)] + [(None, None, None, None, None, "n", 2)], SCHEMA + ", target string, row int")
    out = mixing.copies(df, shard_slots=50)
    assert out.columns == df.columns
    want = {r.doc_id: r.taken for r in mixing.mix(df, shard_slots=50).collect()}
    texts, got = {r.doc_id: r.text or "" for r in df.collect()}, {}
    for r in out.collect():
        words = (r.text or "").split()
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
        assert r.target in "cn" and (r.text is None or len(r.text) == r.n_chars or r.text == texts[r.doc_id])
        left = iter(texts[r.doc_id].split())
        assert all(w in left for w in words)  # in order
    assert got == {d: n for d, n in want.items() if n or not texts[d].strip()}


def omh(text, k=order_minhash.K, buckets=order_minhash.BUCKETS, length=order_minhash.LENGTH):
    """The signature by plain loops, as sets of k-mer tuples."""
    m = (1 << 64) - 1
    of = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    chain = lambda xs: __import__("functools").reduce(lambda s, x: of(struct.pack("<Q", x), s), xs, 42)
    w = [of(x) for x in (text or "").encode().split()]
    if not w:
        return [None] * buckets
    mers = [chain(w)] if len(w) < k else [chain(w[i : i + k]) for i in range(len(w) - k + 1)]
    low, seen, items = (1 << order_minhash.POS) - 1, {}, []
    for i, x in enumerate(mers):
        x &= m ^ low
        n = seen.get(x, 0)
        seen[x] = n + 1
        inner = of(struct.pack("<I", n), of(struct.pack("<Q", x >> order_minhash.POS), 42))
        items.append(inner & (m ^ low) | i)
    out = [None] * buckets
    for b in range(buckets):
        own = sorted((x - (1 << 64) if x >> 63 else x) for x in items if x >> (64 - buckets.bit_length() + 1) == b)[:length]
        if own:
            out[b] = tuple(mers[i] for i in sorted(x & low for x in own))
    return out


def test_order_minhash_against_loops(spark):
    texts = ["a b c d e f g " * 9, "one", "", None, "  x\ty\n", " ".join(str(i % 37) for i in range(2000)), "q q q q q", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.signature for r in order_minhash.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        want = omh(t)
        assert [x is None for x in got[i]] == [x is None for x in want], t
        groups = {}
        for x, y in zip(got[i], want, strict=True):
            if y is not None:
                assert groups.setdefault(y, x) == x


def test_order_minhash_sees_order_and_edits(spark):
    base = [f"w{i}" for i in range(400)]
    edited, shuffled = base[:], base[:]
    edited[50] = "new"
    shuffled = base[200:] + base[:200]
    rows = [(0, " ".join(base)), (1, " ".join(edited)), (2, " ".join(shuffled)), (3, "other text"), (4, ""), (5, None)]
    df = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    sig = {r.doc_id: r.signature for r in df.collect()}
    like = lambda a, b: spark.createDataFrame([(sig[a], sig[b])], "a array<int>, b array<int>").select(order_minhash.likeness(F.col("a"), F.col("b"))).head()[0]
    assert like(0, 0) == 1.0 and like(4, 5) == 1.0 and like(4, 0) == 0.0
    assert like(0, 1) > 0.85 and like(0, 2) < like(0, 1) and like(0, 3) == 0.0
    assert spark.createDataFrame([(sig[0],)], "a array<int>").select(order_minhash.written(F.col("a")).alias("s")).head().s.__len__() == 8 * order_minhash.BUCKETS


def test_rows_without_doc_id_have_an_order(spark, tmp_path):
    rows = [(None, "w " * (i % 7 + 1030 * (i % 2)), "en", f"s{i % 2}", 1) for i in range(60)] + [(i, "v " * 9, "en", "s0", 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:]))
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken", "shards")
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, con.execute(mixing.SQL).fetchall()))
    texts = spark.createDataFrame([(None, f"t{i}") for i in range(40)] + [(1, "one"), (2, "two")], "doc_id long, text string")
    out = order_minhash.with_next(texts, lambda d: d, ["text"]).collect()
    after = {r.text: r.next_text for r in out}
    seen, at = [], "one"
    for _ in out:
        seen.append(at)
        at = after[at]
    assert at == "one" and sorted(seen) == sorted(after) and seen[:2] == ["one", "two"]


def test_next_document_wraps(spark):
    rows = [(i * 3, f"t{i}") for i in range(50)] + [(None, "first"), (6, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = order_minhash.with_next(df, lambda d: d, ["text"], rows_per_bucket=5).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {(a, t): order[(i + 1) % len(order)][1] for i, (a, t) in enumerate(order)}
    assert {(r.doc_id, r.text): r.next_text for r in out} == want
    one = order_minhash.with_next(df.limit(1), lambda d: d, ["text"]).collect()
    assert one[0].next_text == one[0].text


def png(w=3, h=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_wav_is_read_by_another_library():
    payload = media.padded("grüße".encode())
    with wave.open(io.BytesIO(media.wav_bytes(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.wav_samples(media.wav_bytes(payload)) == payload
    assert [len(media.padded(bytes(n))) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_sniff_corrects_and_carves(spark):
    import gzip

    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0" + b"\2\2\x4c\1\0" + b"\x3b"
    broken = bytearray(png())
    broken[20] ^= 1
    gz = gzip.compress(b"hello")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    cases = [(0, "image/jpeg", png()), (1, "image/gif", gif), (2, "image/png", bytes(broken)), (3, None, None), (4, "x", b"junk" + png() + b"mid" + gz), (5, "image/bmp", bmp), (6, "x", b"BM and RIFF in words, GIF89a too"), (7, "audio/wav", media.wav_bytes(media.padded(b"a" + gif)))]
    df = spark.createDataFrame(cases, "id int, declared_type string, media binary").withColumn("media_type", F.lit("clash"))
    out = {r.id: r for r in media.sniff(df).collect()}
    assert [out[i].media_type for i in range(8)] == ["image/png", "image/gif", media.UNKNOWN, media.UNKNOWN, media.UNKNOWN, "image/bmp", media.UNKNOWN, "audio/wav"]
    assert out[0].corrected and not out[1].corrected and not out[7].corrected
    assert [(c.offset, c.length, c.media_type) for c in out[4].carved] == [(4, len(png()), "image/png"), (7 + len(png()), len(gz), "application/gzip")]
    assert [(c.offset, c.media_type) for c in out[7].carved] == [(45, "image/gif")] and out[6].carved == []
    assert out[3].media_bytes == 0


def test_media_round_trip_of_every_text(spark):
    import hashlib

    df = spark.createDataFrame(DOCS, SCHEMA)
    out = media.sniff(media.encode_wav(df.select("doc_id", "text")))
    want = {}
    for d in DOCS:
        p = media.padded((d[1] or "").encode())
        want[d[0]] = (len((d[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out.collect()} == want
    assert media.sniff(media.encode_wav(df.limit(0).select("doc_id", "text"))).count() == 0
