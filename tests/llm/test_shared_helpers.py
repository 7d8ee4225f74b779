import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import bpe, common, katz


def test_stored_tables_can_be_dropped(spark):
    df = common.stored(spark.range(5), "t")
    path = df._stored_at.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    common.drop(df)
    assert not os.path.exists(path)


def test_files_go_to_the_shared_folder(spark):
    data = bytes(range(256)) * 9000
    path = common.put(spark, "blob.bin", data)
    with open(path.removeprefix("file:"), "rb") as f:
        assert f.read() == data
    assert path.removeprefix("file:").startswith(common.shared_dir(spark).removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_repeated_rows_are_dealt_to_all_blocks(spark):
    rows = spark.range(1000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'x' AS text")
    counts = [r["count"] for r in rows.select(common.dealt(8).alias("b")).groupBy("b").count().collect()]
    assert len(counts) == 8 and max(counts) < 250


@pytest.mark.parametrize("most", [0, 255, 256, 70_000, 2**33, 2**55])
def test_packed_numbers(most):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, most + 1, 50), np.r_[rng.integers(0, most + 1, 6), most]
    data = b"xyz" + katz.pack(a) + katz.pack(b) + katz.pack(a[:0])
    x, y, z, at = katz.unpack(data, 50, 7, 0, at=3)
    assert (x == a).all() and (y == b).all() and not len(z) and at == len(data)
    assert len(katz.pack(b)) == 1 + 7 * max(1, -(-most.bit_length() // 8))


def test_merging_equals_plain_loops():
    rng = np.random.default_rng(2)
    ranks = {}
    for r in range(60):  # a pair that a merge makes ranks after it
        a, b = (int(x) for x in rng.integers(0, 8 + r // 2, 2))
        ranks.setdefault((a, b), (r, 8 + r))
    slots = bpe.table_of(ranks)

    def loops(ids):
        while True:
            found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
            if not found:
                return ids
            _, i = min(found)
            ids = [*ids[:i], ranks[ids[i], ids[i + 1]][1], *ids[i + 2 :]]

    pieces = [rng.integers(0, 8, rng.integers(0, 30)).tolist() for _ in range(400)] + [[0] * 20, [1, 1, 1], []]
    flat, size = bpe.merge_pairs(slots, np.array([x for p in pieces for x in p], np.int64), np.array([len(p) for p in pieces]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [loops(p) for p in pieces]


def test_words_are_those_of_python():
    texts = [" a B\tc ", None, "", "É é\x1cx", "one"]
    codes, sizes, words = common.split_words(pa.array(texts))
    words, at = words.to_pylist(), 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert [words[i].encode() for i in codes[at : at + n]] == (t or "").encode().lower().split()
        at += n
