"""Ranked search against scores of every document, with copies, ties, awkward rows and small trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrybook.llm import lexical_search as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, k=50):
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    big_n, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        terms = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in set(split(text)) if df[t]}
        scores = []
        for d, c, n in counted:
            m = 100 - 50 + (50 * n * big_n) // total
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in terms.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Größe", "ÄÖ", "naïve", "日本", "İx"]
    topic = [rnd.sample(words, 25) for _ in range(12)]
    docs = [(i, " ".join(rnd.choices(topic[i % 12] + words[:20], k=rnd.randint(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(300)] + [(2000 + i, docs[6][1] + " more") for i in range(60)]
    docs += [(None, docs[7][1]), (3000, None), (3001, ""), (3002, " .,; "), (5, docs[5][1]), (3003, "W1 w1,W1-" * 50_000), (3004, "w2" * 20_000), ((1 << 60) + 1, docs[8][1]), (-4, docs[8][1])]
    items = [(i, " ".join(rnd.choices(topic[i % 12], k=12)) + "! WORD w1, Größe") for i in range(40)] + [(100, None), (101, ""), (102, "unheard"), (7, "w1 w2"), (None, "w3 日本")]
    return docs, items


def searched(spark, docs, items, k=50):
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, score string").repartition(4)
    return ls.LexicalSearch(table, spark.createDataFrame(items, "item_id long, text string"), k)


def rows(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.results.collect()), key=repr)


def test_equals_scores_of_all_documents(spark):
    docs, items = corpus()
    assert rows(searched(spark, docs, items)) == brute(docs, items)


@pytest.mark.parametrize("limits", [{"TREE_DOCS": 40, "LEAF_DOCS": 3}, {"TREE_ENTRIES": 100, "PIECE": 10, "BLOCK_BYTES": 600}])
def test_small_trees_pieces_and_blocks(spark, monkeypatch, limits):
    docs, items = corpus()
    for name, value in limits.items():
        monkeypatch.setattr(ls, name, value)
    assert rows(searched(spark, docs, items, 7)) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus()
    assert rows(searched(spark, docs[:3], [])) == [] == rows(searched(spark, [], items)) == rows(searched(spark, [(1, None)], items))


def random_rows(n, width, rnd):
    terms = [np.sort(rnd.choice(width, rnd.integers(1, width), replace=False)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    return starts, np.concatenate(terms).astype(np.int64) * 3, rnd.integers(0, 10**6, int(starts[-1]))


def test_bounds_hold_and_prune():
    """No document scores over the bound of a ball around it; whole subtrees are left out, and nothing is lost."""
    rnd = np.random.default_rng(1)
    starts, terms, values = random_rows(60, 30, rnd)
    # ten groups of near copies, so that balls are small
    owner = np.arange(600) // 10
    spans = [np.arange(starts[o], starts[o + 1]) for o in owner]
    at = np.concatenate(spans)
    many = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    made = ls._tree(np.arange(600), many, terms[at], np.maximum(values[at] + rnd.integers(-50, 50, len(at)), 0), leaf_docs=4)
    ball = ls._Ball({name: made[name].astype(kind).tobytes() for name, kind in ls._ARRAYS.items()})
    visited = 0
    for _ in range(30):
        ids = np.sort(rnd.choice(40, 6, replace=False)).astype(np.int64) * 3
        weights = rnd.integers(1, 9000, 6)
        length = math.sqrt(sum(int(w) ** 2 for w in weights))
        scores = np.array([sum(int(w) * int(v) for i, w in zip(ids, weights) for t, v in zip(ball.terms[ball.starts[d] : ball.starts[d + 1]], ball.values[ball.starts[d] : ball.starts[d + 1]]) if t == i) for d in range(600)])
        bounds = ball.bounds(ids, weights, length)[2]
        for (lo, hi, _), bound in zip(ball.nodes, bounds):
            assert scores[lo:hi].max() <= bound
        found, n = ball.best(ids, weights, length, 1, 5)
        visited += n
        assert sorted(found, key=lambda x: (-x[0], x[1])) == sorted(((int(s), int(d)) for s, d in zip(scores, ball.docs) if s > 0), key=lambda x: (-x[0], x[1]))[:5]
    assert visited < 30 * 600
