import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.llm import suffix


def _table(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(5))
    shared = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) + (shared if i % 3 else "") for i in range(n)]
    return pa.table({"doc_id": list(range(n)), "text": texts})


def test_pieces_leave_no_trace(monkeypatch):
    table = _table(1, 40)
    found = []
    for piece in (1 << 19, 1000, 257):
        monkeypatch.setattr(suffix, "PIECE", piece)
        x = suffix.Block(table, 200)
        x.anchors()
        found.append([x.a, x.b, x.gram, x.context, *x.windows(np.arange(len(x.a)))])
    for other in found[1:]:
        assert all((p == q).all() for p, q in zip(found[0], other, strict=True))


def test_grams_by_place_equal_those_by_refinement():
    t = np.frombuffer(bytes(random.Random(2).randrange(256) for _ in range(5000)), np.uint8)
    g = suffix._grams(t)
    at = np.array([0, 7, 8, 1000, len(g) - 1])
    assert len(g) == len(t) - 63 and (suffix._grams_at(t, at) == g[at]).all()


def test_rows_that_repeat_and_columns_that_clash(spark):
    text = "words of a text that is long enough to be cut where it repeats " * 5
    rows = [(None, None)] * 5 + [(7, text)] * 6 + [(8, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("block"), F.lit("x").alias("kind"))
    out = suffix.deduped(docs).collect()
    assert len(out) == 12 and out[0].asDict().keys() == {"doc_id", "text", "block", "kind"}
    assert sorted(r.text for r in out if r.doc_id == 7) == [""] * 6 and all(r.block == 1 and r.kind == "x" for r in out)
