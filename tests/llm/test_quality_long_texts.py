from pulsegrid.llm import quality


def test_shares_of_words_count_every_word():
    at = {name: i for i, name in enumerate(quality.NAMES)}
    for repeats in (2, 2000, 5000, 20000):  # up to 80,000 words
        got = quality.statistics("plain SHOUT wow! incomprehensibilities " * repeats)
        assert [got[at[n]] for n in ("symbol_words", "upper_words", "top_word", "long_words")] == [0.25] * 4
    words = ["w%d" % i for i in range(8192)]
    words[1], words[3], words[5], words[7] = "A!", "LOUD", "x" * 15, "w0"
    got = quality.statistics(" ".join(words))
    assert [got[at[n]] * 8192 for n in ("symbol_words", "upper_words", "top_word", "long_words")] == [1, 2, 2, 1]
