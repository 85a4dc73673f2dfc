"""Exact ranked search of items in documents: integer scores, inner products over a forest of sparse ball trees.

A document is a sparse vector over the asked terms, an item a vector of their weights, the score their inner
product.  Documents lie in order of their rarest asked terms, so that copies and documents of one topic are
neighbours; each run of them is a ball tree.  A ball of centre ``c`` and radius ``r`` holds no document with a score over
``<item, c> + |item| r``; trees and their subtrees are searched best first and left out once that is less than the
score of the k-th best document so far.  Every document in a leaf that is reached is scored exactly.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.llm.words import alnum_words
from quarrybook.plans.staging import Staging, spread

DEPTH = 50
#: Documents of a tree, entries of a tree, documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS = 4096, 1 << 20, 64
#: Bytes of the items' terms of one block; blocks are searched one after the other.
BLOCK_BYTES = 8 << 20
#: Entries of a centre below this are zero: any point may be a centre, and a short one is cheap.
LEAST_CENTRE = 20_000
#: Texts are split into terms in pieces of about so many bytes.
PIECE = 1 << 22
#: Rows that are held as Python values at once.
SLICE = 512
NO_ID = (1 << 63) - 1
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")

# documents as sparse vectors --------------------------------------------------------------


def _counts(text: bytes, known: dict[bytes, int], piece: int = PIECE) -> tuple[int, dict[int, int]]:
    """All terms with repeats, and how often each known term occurs; bytes beyond ASCII are parts of terms, so bytes do."""
    text, n, found, at = text.lower(), 0, Counter(), 0
    while at < len(text):
        gap = GAP.search(text, at + piece) if len(text) - at > piece else None
        end = gap.start() if gap else len(text)
        terms = TERM.findall(text, at, end)
        n += len(terms)
        found.update(map(known.get, terms))
        at = end
    found.pop(None, None)
    return n, found


def _vectors(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema, piece: int) -> Iterator[pa.RecordBatch]:
    known = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            ids, texts = part.column(0).to_pylist(), part.column(1)
            rows: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                n, found = _counts(text.as_py() or b"", known, piece)
                if n:
                    terms = sorted(found)
                    rows.append((doc, n, terms, [found[t] for t in terms]))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ball trees -----------------------------------------------------------------------------------


def _square_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(values, 0), starts[:-1]) * (np.diff(starts) > 0)


def _tree(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf_docs: int = LEAF_DOCS) -> dict[str, np.ndarray]:
    """A ball tree over rows of sparse whole numbers (starts, terms, values): documents in its order, nodes, centres."""
    names, local = np.unique(terms, return_inverse=True)
    width, norms = max(len(names), 1), _square_sums(values * values, starts)

    def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Squared, exact: whole numbers below 2**63 as values are at most 10**6 and a tree has few terms."""
        spans = [np.arange(starts[r], starts[r + 1]) for r in rows]
        at, cuts = np.concatenate(spans), np.concatenate([[0], np.cumsum([len(s) for s in spans])])
        return norms[rows] - 2 * _square_sums(values[at] * centre[local[at]], cuts) + int((centre * centre).sum())

    def dense(row: int) -> np.ndarray:
        out = np.zeros(width, np.int64)
        out[local[starts[row] : starts[row + 1]]] = values[starts[row] : starts[row + 1]]
        return out

    order, nodes, centres = np.arange(len(docs)), [], []
    todo = [(0, len(docs), -1)]
    while todo:
        lo, hi, parent = todo.pop()
        rows = order[lo:hi]
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
        mean = np.bincount(local[at], weights=values[at], minlength=width) / len(rows)
        centre = np.where(mean >= LEAST_CENTRE, np.rint(mean), 0).astype(np.int64)
        apart = distances(rows, centre)
        nodes.append((lo, hi, parent, int(apart.max())))
        centres.append(centre)
        if hi - lo > leaf_docs:
            one = distances(rows, dense(rows[int(apart.argmax())]))
            if one.max() > 0:  # else all are equal
                other = distances(rows, dense(rows[int(one.argmax())]))
                order[lo:hi] = rows[np.argsort(one - other, kind="stable")]
                middle, me = (lo + hi) // 2, len(nodes) - 1
                todo += [(middle, hi, me), (lo, middle, me)]
    spans = [np.arange(starts[r], starts[r + 1]) for r in order]
    at = np.concatenate(spans)
    sparse = [np.nonzero(c)[0] for c in centres]
    return {
        "docs": docs[order], "starts": np.concatenate([[0], np.cumsum([len(s) for s in spans])]), "terms": terms[at].astype(np.int32), "values": values[at].astype(np.int32),
        "nodes": np.array([n[:3] for n in nodes], np.int32).ravel(), "radii": np.array([math.ceil(math.sqrt(n[3]) * (1 + 1e-12)) for n in nodes], np.int64),
        "centre_starts": np.concatenate([[0], np.cumsum([len(s) for s in sparse])]), "centre_terms": names[np.concatenate(sparse)].astype(np.int32), "centre_values": np.concatenate([c[s] for c, s in zip(centres, sparse, strict=True)]).astype(np.int32),
    }


_ARRAYS = {"docs": np.int64, "starts": np.int64, "terms": np.int32, "values": np.int32, "nodes": np.int32, "radii": np.int64, "centre_starts": np.int64, "centre_terms": np.int32, "centre_values": np.int32}
_TREES = "tree long, " + ", ".join(f"{name} binary" for name in _ARRAYS)


def _forest(frames: Iterator[pd.DataFrame], n_docs: int, n_terms: int, limits: tuple[int, int, int]) -> Iterator[pd.DataFrame]:
    """Trees over the rows (row, doc, n, terms, tfs) of a partition as they come; a tree is named by its first row."""

    tree_docs, tree_entries, leaf_docs = limits

    def grown(rows: list[tuple]) -> pd.DataFrame:
        docs = np.array([r[1] for r in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        tfs = np.concatenate([np.asarray(r[4], np.int64) for r in rows])
        pads = np.repeat(np.array([20 * (50 + 50 * int(r[2]) * n_docs // n_terms) for r in rows], np.int64), np.diff(starts))
        made = _tree(docs, starts, np.concatenate([np.asarray(r[3], np.int64) for r in rows]), 10**9 * tfs // (1000 * tfs + pads), leaf_docs)
        return pd.DataFrame([[int(rows[0][0]), *(made[name].astype(kind).tobytes() for name, kind in _ARRAYS.items())]], columns=["tree", *_ARRAYS])

    rows, entries = [], 0
    for frame in frames:
        for row in zip(*(frame[c] for c in ("row", "doc", "n", "terms", "tfs")), strict=True):
            if rows and (len(rows) == tree_docs or entries + len(row[3]) > tree_entries):
                yield grown(rows)
                rows, entries = [], 0
            rows.append(row)
            entries += len(row[3])
    if rows:
        yield grown(rows)


# search ------------------------------------------------------------------------------------------


class _Ball:
    """A stored tree with its terms numbered anew, so that an item looks at few of them."""

    def __init__(self, row: dict):
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.names = np.unique(np.concatenate([self.terms, self.centre_terms]))
        self.local = np.searchsorted(self.names, self.terms)
        self.nodes = self.nodes.reshape(-1, 3)
        self.children: list[list[int]] = [[] for _ in self.nodes]
        for k, (_, _, parent) in enumerate(self.nodes):
            if parent >= 0:
                self.children[parent].append(k)
        self.centres = np.zeros((len(self.nodes), max(len(self.names), 1)), np.int32)
        owner = np.repeat(np.arange(len(self.nodes)), np.diff(self.centre_starts))
        self.centres[owner, np.searchsorted(self.names, self.centre_terms)] = self.centre_values
        self.weights = np.zeros(max(len(self.names), 1), np.int64)

    def bounds(self, terms: np.ndarray, weights: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """No document of a node scores over the node's bound; rounding only ever raises it."""
        at = np.searchsorted(self.names, terms)
        own = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == terms) if len(self.names) else np.zeros(len(terms), bool)
        at, kept = at[own], weights[own]
        return at, kept, self.centres[:, at].astype(np.int64) @ kept + np.ceil(length * self.radii * (1 + 1e-12)).astype(np.int64) + 1

    def best(self, terms: np.ndarray, weights: np.ndarray, length: float, least: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """Up to k (score, doc) with a score of ``least`` or more, and how many documents were scored."""
        at, kept, bounds = self.bounds(terms, weights, length)
        if not len(at):
            return [], 0
        self.weights[at] = kept
        found: list[tuple[int, int]] = []  # the k best so far as (score, -doc), the worst first
        scored, todo = 0, [(-int(bounds[0]), 0)]
        while todo and -todo[0][0] >= least:
            node = heapq.heappop(todo)[1]
            if self.children[node]:
                for child in self.children[node]:
                    if (bound := min(int(bounds[child]), int(bounds[node]))) >= least:
                        heapq.heappush(todo, (-bound, child))
                continue
            lo, hi, _ = self.nodes[node]
            a, b = self.starts[lo], self.starts[hi]
            scores = _square_sums(self.weights[self.local[a:b]] * self.values[a:b], self.starts[lo : hi + 1] - a)
            scored += int(hi - lo)
            for j in np.nonzero(scores >= least)[0]:
                one = (int(scores[j]), -int(self.docs[lo + j]))
                if len(found) < k:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)
            if len(found) == k:
                least = max(least, found[0][0])
        self.weights[at] = 0
        return [(score, -doc) for score, doc in found], scored


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for frame in frames:
        yield from frame.to_dict("records")


def _roots(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """The most promising tree of these for each item."""
    best: dict[int, tuple[int, int]] = {}
    for row in _rows(frames):
        ball = _Ball(row)
        for item, (terms, weights, length) in enumerate(shared.value):
            at, _, bounds = ball.bounds(terms, weights, length)
            if len(at):
                best[item] = max(best.get(item, (-1, 0)), (int(bounds[0]), row["tree"]))
    yield pd.DataFrame([(item, *b) for item, b in best.items()], columns=["item", "bound", "tree"])


_HITS = "item int, score long, doc long, scored long"


def _hits(frames: Iterator[pd.DataFrame], shared, k: int, first: bool) -> Iterator[pd.DataFrame]:
    """The best documents of each tree for each item; ``first``: of the item's most promising tree alone, else of all others.

    A row without an item tells how many were scored."""
    items, least, tree_of = shared.value
    of_tree: dict[int, list[int]] = {}
    for item, tree in enumerate(tree_of):
        of_tree.setdefault(tree, []).append(item)
    for row in _rows(frames):
        done = of_tree.get(row["tree"], [])
        asked = done if first else sorted(set(range(len(items))).difference(done))
        if not asked:
            continue
        ball, out, scored = _Ball(row), [], 0
        for item in asked:
            found, n = ball.best(*items[item], max(least[item], 1), k)
            scored += n
            out += [(item, score, doc, 0) for score, doc in found]
        yield pd.DataFrame([*out, (-1, 0, 0, scored)], columns=["item", "score", "doc", "scored"])


class LexicalSearch:
    """The ``k`` best of ``documents`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII in the whole text.
    ``results``: (item_id, rank, doc_id, score), scores above 0, equal scores by ascending doc_id, null last.
    ``visited``: (pairs, scored): pairs of item and document, and those that were scored.

    Null and empty texts match nothing; every row is a document or an item of its own, repeated ones too; very
    long texts are split in pieces; empty tables give an empty result; further columns are left out.  doc_id is a whole number.

    Items are taken in blocks of ``BLOCK_BYTES`` of terms, whose terms and weights every task holds; the documents are
    read once for each block.  Of the documents only counts for the block's terms come to the driver.
    """

    def __init__(self, documents: DataFrame, items: DataFrame, k: int = DEPTH):
        self.spark, self.k = documents.sparkSession, k
        self.staging = Staging(self.spark, "lexical")
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
        named = items.select("item_id", F.array_distinct(alnum_words(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
        named = self.staging.table(named.withColumn("row", F.monotonically_increasing_id()), "items")
        size = named.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
        n_blocks = max(1, -(-size // BLOCK_BYTES))
        parts = [self._block(named.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b), b) for b in range(n_blocks)]
        self.results, self.visited = parts[0]
        for hits, visited in parts[1:]:
            self.results, self.visited = self.results.unionByName(hits), self.visited.unionByName(visited)

    def _block(self, named: DataFrame, b: int) -> tuple[DataFrame, DataFrame]:
        context, k, table = self.spark.sparkContext, self.k, lambda df, name: self.staging.table(df, f"{name}-{b}")
        items = named.orderBy("row").collect()  # at most BLOCK_BYTES of terms
        held = Counter(t for r in items for t in r["terms"])
        terms = sorted(held, key=lambda t: (held[t], t))  # rare ones first
        known = {t.encode(): i for i, t in enumerate(terms)}
        schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
        shared, piece, limits = context.broadcast(known), PIECE, (TREE_DOCS, TREE_ENTRIES, LEAF_DOCS)
        vectors = spread(self.documents).mapInArrow(lambda batches: _vectors(batches, shared, schema, piece), "doc long, n long, terms array<int>, tfs array<long>")
        vectors = table(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each asked term at most
        known_ids = [np.array(sorted(known[t.encode()] for t in r["terms"] if known[t.encode()] in df), np.int64) for r in items]
        asked = [(ids, np.array([weight(n_docs, df[i]) for i in ids.tolist()], np.int64)) for ids in known_ids]
        asked = [(ids, w, math.sqrt(sum(x * x for x in w.tolist()))) for ids, w in asked]

        rare = [F.coalesce(F.get("terms", F.lit(j)), F.lit(-1)).alias(f"t{j}") for j in range(3)]
        order = ["t0", "t1", "t2", "row"]
        lain = vectors.where(F.size("terms") > 0).select("row", F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "n", "terms", "tfs", *rare).repartitionByRange(*order).sortWithinPartitions(*order)
        trees = table(lain.select("row", "doc", "n", "terms", "tfs").mapInPandas(lambda frames: _forest(frames, n_docs, n_terms, limits), _TREES), "trees")
        self.staging.drop(f"vectors-{b}")

        told = context.broadcast(asked)
        best = trees.mapInPandas(lambda frames: _roots(frames, told), "item int, bound long, tree long")
        first = dict(best.groupBy("item").agg(F.max_by("tree", F.struct("bound", "tree"))).collect())  # a row for each item
        tree_of, least = [first.get(i, -1) for i in range(len(items))], [1] * len(items)
        start = context.broadcast((asked, least, tree_of))
        opened = trees.join(F.broadcast(self.spark.createDataFrame([(t,) for t in set(tree_of)], "tree long")), "tree", "left_semi") if items else trees
        seeds = table(opened.mapInPandas(lambda frames: _hits(frames, start, k, True), _HITS), "seeds")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc"))
        reached = seeds.where("item >= 0").withColumn("rank", rank).where(F.col("rank") == k).select("item", "score")
        for item, score in reached.collect():
            least[item] = score
        goal = context.broadcast((asked, least, tree_of))
        others = table(trees.mapInPandas(lambda frames: _hits(frames, goal, k, False), _HITS), "others")
        self.staging.drop(f"trees-{b}")
        both = seeds.unionByName(others)
        hits = both.where("item >= 0").withColumn("rank", rank).where(F.col("rank") <= k)
        ids = self.spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {named.schema['item_id'].dataType.simpleString()}")
        results = hits.join(F.broadcast(ids), "item").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
        return results, both.agg(F.lit(n_docs * len(items)).cast("long").alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
