import random

import pytest

from pulsegrid.llm import windows


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("size,edits", [(55, 1), (60, 1), (70, 1), (90, 2), (120, 2), (200, 4)])
def test_planted_passages_of_similarity_08_are_found(spark, size, edits):
    """Pairs of texts that share a passage with words changed at random places; those of similarity 0.8 or more by brute force count."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, alike = [], []
    for i in range(60):
        passage = [word() for _ in range(size)]
        other = passage[:]
        for at in rng.sample(range(size), edits):
            other[at] = word()
        a, b = _shingles(passage), _shingles(other)
        if len(a & b) / len(a | b) >= 0.8:
            alike.append(i)
        around = lambda: [word() for _ in range(rng.randint(0, 40))]
        rows += [(2 * i, " ".join(around() + passage + around())), (2 * i + 1, " ".join(around() + other + around()))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in windows.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) >= 10
    found = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in alike)
    assert found >= 0.9 * len(alike)
    assert all(d // 2 == c // 2 for d, (c, _) in got.items())  # nothing links different pairs


def test_partitions_do_not_show(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(5))
    hot, warm = [word() for _ in range(60)], [word() for _ in range(90)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 90))] + (hot if i % 3 == 0 else warm if i % 5 == 0 else []) + [word() for _ in range(30)])) for i in range(150)]
    df, old, found = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(tuple(r) for r in windows.passage_classes(df.repartition(int(n))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] and {(c, n) for d, c, n in found[0] if d % 3 == 0} == {(0, 49)}
