"""A quality classifier on random-indexing word vectors.

Every token bucket has a fixed sparse ternary index vector; a bucket's word
vector is the sum of the index vectors found around it, over all documents.  A
document is pooled to the mean of its tokens' word vectors and of their squares.
A network of two layers in numpy, fitted on a bounded sample of labelled rows,
turns that into a probability, calibrated by a temperature on rows that the fit
did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybook.llm.language import held_out
from quarrybook.plans.staging import Staging

#: Token buckets, dimensions of a vector, and non-zero places of an index vector.
BUCKETS = 1 << 13
DIM = 48
NONZERO = 6
#: Neighbours on each side that count as context.
REACH = 2
#: Most labelled rows that the network is fitted on: those with the least hash of their id.
SAMPLE = 20_000
CHUNK_BYTES = 1 << 18
HIDDEN = 32
EPOCHS = 40
SEED = 7

#: Character classes of a token: blank, letter (and all beyond ASCII), digit, other.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
#: Buckets for two marks: a word in capitals, a token that repeats the one before.
CAPITALS, REPEATED = 0, 1


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    table = np.zeros((BUCKETS, DIM), np.float32)
    for row in table:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return table


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token buckets of all texts in turn, number of tokens of each text)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    starts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    kind = _CLASS[data]
    head = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0)) + 1
    if not len(head):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    end = edge[np.minimum(np.searchsorted(edge, head, side="right"), len(edge) - 1)]
    end = np.where(end > head, end, len(data))
    # equal tokens must hash alike wherever they stand: sums of bytes, of squares and of neighbouring pairs
    code = _FOLD[data]
    follows = np.append(code[1:], np.uint32(0))
    parts = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64), dtype=np.uint64)]) for x in (code, code * code, code * 31 * (follows + 7))]
    spans = [p[end] - p[head] for p in parts]
    spans[2] -= (code[end - 1] * 31 * (follows[end - 1] + 7)).astype(np.uint64)
    first, last = code[head].astype(np.uint64), code[end - 1].astype(np.uint64)
    mixed = spans[0] + spans[1] * np.uint64(1000003) + spans[2] * np.uint64(998244353) + first * np.uint64(7919) + last * np.uint64(104729) + (end - head).astype(np.uint64) * np.uint64(15485863)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (2 + (mixed >> np.uint64(33)) % np.uint64(BUCKETS - 2)).astype(np.int64)
    owner = np.searchsorted(starts, head, side="right") - 1
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = (upper[end] - upper[head] == end - head) & (end - head > 1)
    again = np.append(False, (bucket[1:] == bucket[:-1]) & (owner[1:] == owner[:-1]))
    # marks stand before their token
    extra = capitals.astype(np.int64) + again
    at = np.arange(len(bucket)) + np.cumsum(extra)
    out = np.empty(len(bucket) + int(extra.sum()), np.int64)
    out[at] = bucket
    out[at[capitals] - 1] = CAPITALS
    out[at[again] - 1 - capitals[again]] = REPEATED
    return out, np.bincount(np.repeat(owner, 1 + extra), minlength=len(texts))[: len(texts)]


def _octets(column: pa.Array) -> list[bytes]:
    return pc.cast(pc.fill_null(column, ""), pa.binary()).to_pylist()


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about CHUNK_BYTES together; a longer text alone."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= CHUNK_BYTES):
            held += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(at + CHUNK_BYTES, len(text))
        if end < len(text):
            end = text.rfind(b" ", at, end) + 1 or end
        yield text[at:end]
        at = end


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], bool]]:
    """(first text, texts, whether it is a piece of one long text)."""
    for at, run in _runs(texts):
        if len(run) == 1 and len(run[0]) > CHUNK_BYTES:
            for piece in _pieces(run[0]):
                yield at, [piece], True
        else:
            yield at, run, False


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = _index_vectors(), np.zeros((BUCKETS, DIM), np.float64)
    seen = np.zeros(BUCKETS, bool)
    for batch in batches:
        for _, texts, _ in _chunks(_octets(batch.column("text"))):
            found, counts = tokens(texts)
            if not len(found):
                continue
            vectors = index[found]
            owner = np.repeat(np.arange(len(texts)), counts)
            around = np.zeros_like(vectors)
            for k in range(1, REACH + 1):
                same = (owner[k:] == owner[:-k])[:, None]
                around[k:] += vectors[:-k] * same
                around[:-k] += vectors[k:] * same
            order = np.argsort(found, kind="stable")
            ranked = found[order]
            first = np.flatnonzero(np.diff(ranked, prepend=-1))
            total[ranked[first]] += np.add.reduceat(around[order], first, axis=0)
            seen[ranked[first]] = True
    rows = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(np.rint(total[rows, j]).astype(np.int64)) for j in range(DIM))], ["bucket", *(f"v{j}" for j in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all documents: BUCKETS rows of unit length (or zero).  The sums are Spark's; they are whole numbers, so their order does not matter."""
    names = [f"v{j}" for j in range(DIM)]
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_rows, "bucket int, " + ", ".join(f"{c} long" for c in names))
    summed = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    table = np.zeros((BUCKETS, DIM))
    table[summed["bucket"].to_numpy(np.int64)] = summed[names].to_numpy(float)
    centred = table - table.sum(axis=0) / max(1, (table != 0).any(axis=1).sum())
    centred[~(table != 0).any(axis=1)] = 0
    return (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean of the word vectors and of their squares for each text; zeros for a text without tokens."""
    sums, n = np.zeros((len(texts), 2 * DIM)), np.zeros(len(texts))
    for at, run, _ in _chunks(texts):
        found, counts = tokens(run)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        v = vectors[found]
        sums[at + full, :DIM] += np.add.reduceat(v, first, axis=0)
        sums[at + full, DIM:] += np.add.reduceat(v * v, first, axis=0)
        n[at + full] += counts[full]
    return sums / np.maximum(n, 1)[:, None]


def _pool_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pooled = pool(_octets(batch.column("text")), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(pooled.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


class Network:
    """Two layers; fitted with Adam on weighted cross-entropy."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, temperature: float):
        self.weights, self.mean, self.scale, self.temperature = weights, mean, scale, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return (np.maximum((x - self.mean) / self.scale @ w["a"] + w["b"], 0) @ w["c"] + w["d"])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        """Without rows, every probability is 0.5; rows of one label give a network that knows only that one."""
        rng = np.random.default_rng(SEED)
        wide = 2 * DIM
        w = {"a": rng.normal(0, (2 / wide) ** 0.5, (wide, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, 1)), "d": np.zeros(1)}
        if not len(y):
            return cls(w | {"c": np.zeros((HIDDEN, 1))}, np.zeros(wide), np.ones(wide), 1.0)
        order = rng.permutation(len(y))
        x, y = x[order], y[order]
        cut = len(y) - len(y) // 5
        mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-3
        z, t = (x[:cut] - mean) / scale, y[:cut]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(cut), max(1, cut // 64)):
                h = np.maximum(z[rows] @ w["a"] + w["b"], 0)
                p = 1 / (1 + np.exp(-np.clip((h @ w["c"] + w["d"])[:, 0], -60, 60)))
                g = ((p - t[rows]) / len(rows))[:, None]
                back = (g @ w["c"].T) * (h > 0)
                grads = {"a": z[rows].T @ back + 1e-4 * w["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * w["c"], "d": g.sum(axis=0)}
                step += 1
                for k, grad in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w[k] = w[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        found = cls(w, mean, scale, 1.0)
        if cut < len(y):
            logits, held = found.logits(x[cut:]), y[cut:]
            losses = {t: np.logaddexp(0, np.where(held > 0.5, -logits, logits) / t).mean() for t in np.geomspace(0.5, 8, 41)}
            found.temperature = float(min(losses, key=losses.__getitem__))
        return found


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> QualityModel:
        """``docs`` (doc_id, text): all documents.  ``labels`` (doc_id, y): the rows to learn from; at most ``sample`` of them are used."""
        spark = docs.sparkSession
        vectors = word_vectors(docs, text_col)
        shared = spark.sparkContext.broadcast(vectors)
        known = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
        chosen = F.broadcast(Staging(spark, "quality").table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen"))  # at most `sample` rows
        rows = docs.select("doc_id", F.col(text_col).alias("text")).join(chosen, "doc_id")
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, x array<double>"
        found = rows.mapInArrow(lambda b: _pool_rows(b, shared), schema).toPandas().sort_values("doc_id", kind="stable")
        x = np.array(found["x"].tolist()) if len(found) else np.zeros((0, 2 * DIM))
        return cls(vectors, Network.fit(x, found["y"].to_numpy(float)))


def _score_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vectors, network = shared.value
    for batch in batches:
        score = network.probability(pool(_octets(batch.column("text")), vectors))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "score"])


def score(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score (0 to 1) and predicted (1 from 0.5 on), one row for each of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.network))
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    found = rows.mapInArrow(lambda b: _score_rows(b, shared), f"{schema}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows (crc32 of the id mod 3 = 1) are not read.

    Null and empty texts have a pooled vector of zeros and are scored like any
    other.  Null labels and labels without a document are passed over; of several labels
    of one document the greatest counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(~held_out(F.col("doc_id"), 3, 1))
    return score(rows, QualityModel.fit(rows, known), ["doc_id", "held_out"])
