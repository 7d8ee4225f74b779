import random

import numpy as np

from pulsegrid.llm import windows


def _pairs(spark, pairs):
    rows = [(2 * i + k, " ".join(t)) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    got = {r.doc_id: r.class_id for r in windows.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def test_short_passages_with_one_changed_word(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    for size in (50, 55, 60, 70, 80):
        pairs = []
        for _ in range(40):
            passage = words(size)
            other = passage[:]
            other[size // 2] = "changed"
            pairs.append((words(rng.randint(0, 60)) + passage + words(30), words(rng.randint(0, 60)) + other + words(30)))
        found = sum(_pairs(spark, pairs))
        print(f"{size} words: {found} of 40")
        assert found >= 38
    apart = [(words(20) + p + words(20), words(20) + p + words(20)) for p in (words(30) for _ in range(40))]
    assert not any(_pairs(spark, apart))


def test_search_links_what_a_leader_would_hide():
    rng = np.random.default_rng(5)
    first = rng.integers(1, 1 << 32, windows.WIDE).astype("<u4")
    second, third = first.copy(), first.copy()
    second[94:98] = rng.integers(1, 1 << 32, 4)
    third[: windows.AROUND - 22] = rng.integers(1, 1 << 32, windows.AROUND - 22)
    third[windows.AROUND + 24 :] = rng.integers(1, 1 << 32, windows.AROUND - 23)
    a, b = windows._search(np.stack([first, third, second]), 46)
    assert len(a) == 2 and {*a, *b} == {0, 1, 2}
