import random

import numpy as np

import corpus_pipeline
from pulsegrid.llm import shingles


def test_pipeline_stage_finds_similarity_of_four_fifths_and_no_less(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, alike = [], 0
    for i in range(300):
        text = [word() for _ in range(300)]
        other = text[:]
        edits = 6 if i % 2 else 7  # similarity 266 / 326 = 0.816 and 261 / 331 = 0.789
        for k in range(edits):
            other[20 + 40 * k] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        alike += edits == 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    found = sum(2 * i + 1 not in kept for i in range(300) if i % 2)
    print(f"recall at similarity 0.816: {found} of {alike}")
    assert found >= 0.98 * alike and all(2 * i in kept for i in range(300))
    assert all(2 * i + 1 in kept for i in range(0, 300, 2))


def test_groups_against_brute_force():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(12)]
    sets = []
    for _ in range(150):
        x = base[rng.integers(12)].copy()
        n = rng.integers(0, 14)
        x[rng.choice(60, n, replace=False)] = rng.integers(0, 1 << 60, n).astype(np.uint64)
        sets.append(np.unique(x))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert shingles.groups(sets) == label and 12 < len(set(label)) < 150


def _sets(rows):
    return [shingles.shingles(r[1]) for r in rows]


def _components(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def _families(seed):
    """Families of near copies that drift, so that links chain, with outsiders that share bands; copies, nulls, empties, repeated doc_ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(25):
            text = text[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(120)] = word()
            texts.append(" ".join(text))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(900, ""), (901, None), (902, " "), (903, "one"), (904, "One"), (905, texts[3]), (None, texts[3]), (None, "alone with no id"), (7, "same id, other text"), (7, texts[7]), (None, None)]


def test_groups_on_spark_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SLICE", 4)
    rows = _families(5)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, row int").repartition(3)
    want = {}
    for r, g in zip(rows, _components(_sets(rows)), strict=True):
        want.setdefault(g, set()).add(r)
    got = {}
    found = {r.node: r.group for r in shingles.near_copies(docs.select("doc_id", "text")).collect()}
    nodes = {r.text: r.n for r in docs.select("text", shingles._node().alias("n")).collect()}
    for r in rows:
        got.setdefault(found[nodes[r[1]]], set()).add(r)
    assert sorted(map(repr, map(sorted, map(lambda g: [repr(x) for x in g], got.values())))) == sorted(map(repr, map(sorted, map(lambda g: [repr(x) for x in g], want.values()))))
    kept = [(r.doc_id, r.text) for r in shingles.one_of_each(docs).collect()]
    assert len(kept) == len(want) and shingles.one_of_each(docs).columns == docs.columns
    for g in want.values():
        least = min((d is None, d or 0) for d, _ in g)
        assert sum((d is None, d or 0) == least and (d, t) in g for d, t in kept) == 1
    assert shingles.one_of_each(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SLICE", 16)
    text = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(text[:50] + [f"x{i}"] + text[51:])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in shingles.one_of_each(docs).collect()] == [0]
