"""Texts in many languages, and long ones by the counts of their words."""

import random

import numpy as np

from quarrybook.llm import language


def model(n):
    rng = random.Random(1)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 8], k=6)) for _ in range(80)] for k in range(n)]
    table = np.full((n, language.BUCKETS), language.SMOOTHING)
    for k, own in enumerate(words):
        np.add.at(table[k], language.trigrams(language._joined([(" ".join(own)).encode()])[0])[0], 50)
    return words, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def test_sets_of_more_than_three_languages():
    words, logs = model(8)
    for n in range(1, 9):
        text = " ".join(" ".join(own) for own in words[:n]).encode()
        scores, counts = language._word_scores([text, b"", " ".join(words[7]).encode()], logs)
        chosen, _, sizes = language.mixtures(scores, counts[[0, 2]])
        assert sizes.tolist() == [n, 1] and set(np.flatnonzero(chosen[:, 0] > 0)) == set(range(n))
        assert np.abs(chosen[:n, 0] - 1 / n).max() < 0.05


def test_long_texts_count_each_word(monkeypatch):
    words, logs = model(5)
    rng = random.Random(2)
    text = " ".join(rng.choices([w for own in words for w in own] + ["other", "words"], k=60_000)).encode()
    scores, counts = language._word_scores([text], logs)
    monkeypatch.setattr(language, "CHUNK_BYTES", 1 << 10)  # so the text is beyond 64 chunks
    distinct, times = language._long_scores(text, logs, 1 << 14)
    assert times.sum() == counts[0] == 60_000 and distinct.shape[1] <= 402
    one, many = language.mixtures(scores, counts), language.mixtures(distinct, np.array([len(times)]), times)
    assert one[2].tolist() == many[2].tolist() == [5]
    assert np.abs(one[0] - many[0]).max() < 1e-3 and np.abs(one[1] - many[1]).max() < 1e-3
