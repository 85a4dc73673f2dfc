"""Near-duplicates: the second round, repeated ids, lists of many documents without a link, and brute force over a given table."""

import os
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from quarrybook.llm import near_dedup

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def links(sets):
    """All pairs of different sets with a similarity of 0.75 or more, by counting the common shingles of all pairs."""
    lists, found = defaultdict(list), []
    for k, s in enumerate(sets):
        common = Counter()
        for x in s:
            common.update(lists[x])
            lists[x].append(k)
        found += [(j, k) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    return found


def components(rows):
    """doc_id of the component for each row, every row a node of its own."""
    classes = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        if s := shingles(t):
            classes[s].append(k)
    sets = list(classes)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links(sets):
        parent[find(a)] = find(b)
    least = {}
    for c, s in enumerate(sets):
        least[find(c)] = min([least.get(find(c), 1 << 60), *(rows[k][0] for k in classes[s])])
    out = [i for i, _ in rows]
    for c, s in enumerate(sets):
        for k in classes[s]:
            out[k] = least[find(c)]
    return out


def check(spark, rows):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(i, len(shingles(t)), c, i == c) for (i, t), c in zip(rows, components(rows), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    return got


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = b.replace("b30", "other")
    got = check(spark, [(3, a), (5, a), (5, b), (7, near), (9, b), (9, b), (9, a)])
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 3), (9, 5), (9, 5)]
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (7, near, 4), (9, "", 5), (9, a, 6), (None, a, 7)], f"{SCHEMA}, text_key int")
    assert sorted(r["text_key"] for r in near_dedup.one_of_each_group(docs).collect()) == [1, 3, 5, 7]


def test_pairs_at_the_threshold(spark):
    """Exactly 75 %, and just below it, on both sides of the sketches' sizes; chained, so that the second round finds some."""
    rows = []
    for i, (n, common) in enumerate([(252, 216), (252, 215), (70, 60), (70, 59), (700, 600), (595, 510), (2100, 1800), (3500, 3000)] * 3):
        shared = " ".join(f"s{i}w{k}" for k in range(common + 4))
        rows += [(100 + 3 * i + s, shared + "".join(f" {s}{i}w{k}" for k in range(n - common))) for s in range(3)]
    check(spark, rows)


def test_many_documents_with_a_common_line_and_no_link(spark):
    line = " ".join(f"c{k}" for k in range(17))
    took = []
    for n in (500, 4000):
        rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(4))) for i in range(n)]
        start = time.time()
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        took.append(time.time() - start)
        assert len(got) == n and all(r["kept"] for r in got)
    assert took[1] < 3 * took[0] + 5  # eight times the documents are no sixty-four times the work


def variants(words, ids, edits, seed):
    """The text of ``words`` in the middle of ``ids``, and for all other ids one with ``edits`` words of its own in places of their own."""
    draw, rows = random.Random(seed), []
    for i in ids:
        own = set(draw.sample(range(len(words)), edits)) if i != ids[len(ids) // 2] else ()
        rows.append((i, " ".join(f"e{i}x{k}" if k in own else w for k, w in enumerate(words))))
    return rows


def counted(monkeypatch):
    """The pairs that are tested from now on, by the name of the round."""
    tested, confirm = {}, near_dedup.NearDuplicates.confirm
    monkeypatch.setattr(near_dedup.NearDuplicates, "confirm", lambda self, pairs, reps, name: tested.update({name: pairs.count()}) or confirm(self, pairs, reps, name))
    return tested


def test_variants_linked_through_one_text_alone(spark, monkeypatch):
    """Hardly any two variants are similar enough, all are to the text they come from: one component, and pairs in proportion to its size."""
    tested = counted(monkeypatch)
    rows = variants([f"w{k}" for k in range(150)], range(1, 301), 4, 1)
    assert {r["component_id"] for r in check(spark, rows)} == {1}
    assert sum(tested.values()) < 20 * len(rows)  # 300 * 299 / 2 = 44,850


def unlike_variants(n, ids, seed):
    """A text of ``n`` words for the first id, and for the others that text with up to a tenth of its words drawn anew."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(2000)}" for _ in range(n)]
    for i in ids:
        own = set(draw.sample(range(n), int(draw.random() * n / 10))) if i != ids[0] else ()
        yield i, " ".join(f"v{draw.randrange(300)}" if k in own else w for k, w in enumerate(words))


def test_long_variants_just_below_the_threshold(spark, monkeypatch):
    """Texts of more shingles than any sketch has values, many of them a little too unlike each other: only few pairs are tested, and no link is lost."""
    tested = counted(monkeypatch)
    rows = list(unlike_variants(3000, range(150), 1))
    kept = sum(r["kept"] for r in check(spark, rows))
    assert 75 < kept < 150
    assert sum(tested.values()) < 10 * len(rows)  # 150 * 149 / 2 = 11,175


def test_sizes_at_the_threshold_across_components(spark, monkeypatch):
    """Cut texts: sets within one another whose sizes are just near enough, or just not, found by the pairs across components alone."""
    monkeypatch.setattr(near_dedup.NearDuplicates, "neighbours", lambda self, lists, components, tested, name, centres: tested.where("false"))
    monkeypatch.setattr(near_dedup.NearDuplicates, "stars", lambda self, index: self.staging.table(index.selectExpr("node AS a", "node AS b").where("false"), "stars"))
    rows = []
    for i, (n, cut) in enumerate([(1000, 750), (1000, 749), (2000, 1500), (2000, 1499), (100, 75), (100, 74), (700, 699), (8, 6), (8, 5)]):
        rows += [(10 * i + k, " ".join(f"t{i}w{j}" for j in range(m + 4))) for k, m in enumerate((n, cut))]
    check(spark, rows)


def test_stage_keeps_one_of_linked_variants(spark, monkeypatch):
    """The pipeline's stage: one of the variants stays, and others' rows are as they were, without all pairs."""
    tested = counted(monkeypatch)
    rows = [*variants([f"w{k}" for k in range(150)], range(2, 202), 4, 3), (1, "another text of its own"), (300, None)]
    assert sorted(map(tuple, near_dedup.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, "another text of its own"), rows[0], (300, None)]
    assert sum(tested.values()) < 20 * len(rows)  # 200 * 199 / 2 = 19,900


def test_stage_tests_few_pairs_of_long_variants(spark, monkeypatch):
    """The pipeline's stage, with long variants somewhat below the threshold: the least of each component stays, without all pairs."""
    tested = counted(monkeypatch)
    rows = list(unlike_variants(3000, range(150), 2))
    want = [r for r, c in zip(rows, components(rows), strict=True) if r[0] == c]
    assert sorted(map(tuple, near_dedup.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    assert sum(tested.values()) < 10 * len(rows)  # 150 * 149 / 2 = 11,175


def test_rounds_of_more_centres(spark, monkeypatch):
    """Two groups whose texts are just too unlike, so pairs across components are left after a round that found links."""
    tested = counted(monkeypatch)
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", 0)
    words = [f"w{k}" for k in range(150)]
    other = [f"v{k}" if k in (20, 50, 80, 110, 140) else w for k, w in enumerate(words)]
    check(spark, variants(words, range(1, 61), 3, 1) + variants(other, range(61, 121), 3, 2))
    assert {"near-1", "near-2"} <= set(tested)


def test_whole_table_equals_brute_force(spark):
    """All 10,000 documents of sf0.1: recall of links' components by length band."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = dict(zip([i for i, _ in rows], components(rows), strict=True))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    found, linked = Counter(), Counter()
    for i, c in want.items():
        if c != i:
            band = len(str(got[i]["n_shingles"]))
            linked[band] += 1
            found[band] += got[i]["component_id"] == c
    assert linked and all(found[b] == n for b, n in linked.items())
    assert all(got[i]["component_id"] == c for i, c in want.items())
