"""Language proportions of documents by expectation-maximisation over n-grams.

Each learned language is a distribution over hashed byte trigrams of lower-cased
words.  A document's words are drawn from a mixture of languages: EM estimates
the proportions, for growing sets of languages, and the set with the best
penalised likelihood is chosen.  Sets grow until a bound on the likelihood of any
mixture shows that no larger one can be better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the trigram hash; a power of two.
BUCKETS = 1 << 15
#: Most languages that are learned; more distinct labels are an error, as the model is held whole.
MOST_LANGUAGES = 200
#: Added to every count.
SMOOTHING = 0.5
#: Bytes of text that are scored at once with few languages.
CHUNK_BYTES = 1 << 18
#: Rows that are turned into Python values at once.
SLICE_ROWS = 512
#: EM steps for each set of languages.
STEPS = 8
#: Log-likelihood that a further language must bring, times the log of the number of words.
PENALTY = 6.0
UNKNOWN = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with blanks between, and where each text starts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    return _LETTERS[data], np.concatenate([[1], 1 + np.cumsum(lengths)[:-1]]) if len(texts) else np.empty(0, np.int64)


def trigrams(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of the trigram around each letter."""
    at = np.flatnonzero(octets != 32)
    wide = octets.astype(np.uint32)
    code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15), at


def _lowered(column: pa.Array) -> list[bytes]:
    return pc.cast(pc.utf8_lower(pc.fill_null(column, "")), pa.binary()).to_pylist()


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in pieces that end at a blank, if there is one."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            end = text.rfind(b" ", at, end) + 1 or end
        yield text[at:end]
        at = end


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that no whole batch is held a second time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in _slices(batches):
        labels = batch.column("lang").to_pylist()
        texts = _lowered(batch.column("text"))
        order = sorted(range(len(labels)), key=labels.__getitem__)
        held: list[bytes] = []
        size = 0
        for k, i in enumerate(order):
            held.append(texts[i])
            size += len(texts[i])
            if size > CHUNK_BYTES or k + 1 == len(order) or labels[order[k + 1]] != labels[i]:
                total = counts.setdefault(labels[i], np.zeros(BUCKETS, np.int64))
                for piece in _pieces(b" ".join(held), 4 * CHUNK_BYTES):
                    total += np.bincount(trigrams(_joined([piece])[0])[0], minlength=BUCKETS)
                held, size = [], 0
    for lang, total in counts.items():
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["lang", "gram", "n"])


class LanguageModel:
    """Sorted languages and their log probabilities, one row of ``BUCKETS`` for each."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @classmethod
    def fit(cls, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
        """Learn from all rows whose language is not null; counts are summed by Spark."""
        rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        known = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()  # before any task counts for so many
        if known > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages, which the model does not hold")
        counts = rows.mapInArrow(_count_rows, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        found = counts.toPandas()
        languages = sorted(found["lang"].unique())
        table = np.full((len(languages), BUCKETS), SMOOTHING)
        place = {lang: k for k, lang in enumerate(languages)}
        np.add.at(table, (found["lang"].map(place).to_numpy(np.int64), found["gram"].to_numpy(np.int64)), found["n"].to_numpy(float))
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _word_scores(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages x words log-likelihoods, number of words of each text)."""
    octets, starts = _joined(texts)
    grams, at = trigrams(octets)
    if not len(at):
        return np.zeros((len(logs), 0), np.float32), np.zeros(len(texts), np.int64)
    head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    words = np.add.reduceat(logs[:, grams], head, axis=1)
    return words, np.diff(np.searchsorted(at[head], np.append(starts, len(octets))))


def _distinct(words: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each occurs."""
    rows = np.ascontiguousarray(words.T)
    _, at, inverse = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return words[:, at], np.bincount(inverse.ravel(), weights=times, minlength=len(at)).astype(np.int64)


def _long_scores(text: bytes, logs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(languages x distinct words log-likelihoods, how often each occurs) of one long text, piece by piece."""
    words, times = np.zeros((len(logs), 0), np.float32), np.zeros(0, np.int64)
    held, n_held = [], 0
    pieces = _pieces(text, size)
    while True:
        piece = next(pieces, None)
        if piece is not None:
            scores = _word_scores([piece], logs)[0]
            if scores.shape[1]:
                held.append(_distinct(scores, np.ones(scores.shape[1], np.int64)))
                n_held += held[-1][0].shape[1]
        if held and (piece is None or n_held > max(1 << 16, words.shape[1])):
            words, times = _distinct(np.concatenate([words, *(w for w, _ in held)], axis=1), np.concatenate([times, *(t for _, t in held)]))
            held, n_held = [], 0
        if piece is None:
            return words, times


def _em(weight: np.ndarray, owner: np.ndarray, first: np.ndarray, counts: np.ndarray, times: np.ndarray | None, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document; weight: languages x words, at most 1; each word counts ``times``."""
    for _ in range(STEPS):
        joint = shares[:, owner] * weight
        joint /= np.maximum(joint.sum(axis=0), 1e-30)
        if times is not None:
            joint = joint * times
        shares = np.add.reduceat(joint, first, axis=1) / counts
    likely = np.log(np.maximum((shares[:, owner] * weight).sum(axis=0), 1e-30))
    return shares, np.add.reduceat(likely if times is None else likely * times, first)


def _most_likely(weight: np.ndarray, owner: np.ndarray, first: np.ndarray, counts: np.ndarray, times: np.ndarray | None, shares: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """A log-likelihood that no mixture exceeds: the function is concave, so its slope at ``shares`` bounds it."""
    slope = weight / np.maximum((shares[:, owner] * weight).sum(axis=0), 1e-30)
    steepest = np.add.reduceat(slope if times is None else slope * times, first, axis=1).max(axis=0)
    return np.minimum(0.0, likely + steepest - counts + 1e-3 * (1 + np.abs(likely)))  # the last part is for rounding


def mixtures(words: np.ndarray, counts: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of at least one word each: chosen proportions, proportions over all languages, set size.

    ``counts``: columns of ``words`` for each document; each counts as one word or, if given, as ``times`` words.
    """
    n_lang, n_docs = len(words), len(counts)
    spans = counts
    owner = np.repeat(np.arange(n_docs), spans)
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    if times is not None:
        counts = np.add.reduceat(times, first)
    top = words.max(axis=0)
    weight = np.exp(words - top)
    alone = np.add.reduceat(words - top if times is None else (words - top) * times, first, axis=1)
    everything, likely = _em(weight, owner, first, counts, times, np.full((n_lang, n_docs), 1 / n_lang, np.float32))
    bound = _most_likely(weight, owner, first, counts, times, everything, likely)
    best = np.zeros((n_lang, n_docs), np.float32)
    best[alone.argmax(axis=0), np.arange(n_docs)] = 1
    best_score, sizes = alone.max(axis=0).astype(float), np.ones(n_docs, np.int64)
    order = np.argsort(-everything, axis=0, kind="stable")
    for m in range(2, n_lang + 1):
        # larger sets cannot be better where the bound less the penalty is not
        still = np.flatnonzero(best_score < bound - PENALTY * (m - 1) * np.log1p(counts))
        if not len(still):
            break
        taken = np.isin(owner, still)
        mask = np.zeros((n_lang, len(still)), np.float32)
        np.put_along_axis(mask, order[:m, still], 1 / m, axis=0)
        begin = np.concatenate([[0], np.cumsum(spans[still])[:-1]])
        shares, likely = _em(weight[:, taken], np.repeat(np.arange(len(still)), spans[still]), begin, counts[still], None if times is None else times[taken], mask)
        score = likely - PENALTY * (m - 1) * np.log1p(counts[still])
        better = score > best_score[still]
        chosen = still[better]
        best[:, chosen], best_score[chosen], sizes[chosen] = shares[:, better], score[better], m
    return best, everything, sizes


def _predict_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    languages, logs = model.value
    size = max(1 << 14, min(CHUNK_BYTES, (CHUNK_BYTES * 8) // max(1, len(languages))))
    names = np.array([*languages, UNKNOWN], dtype=object)

    def answer(start: int, n: int, known: np.ndarray, words: np.ndarray, counts: np.ndarray, batch: pa.RecordBatch, times: np.ndarray | None = None) -> pa.RecordBatch:
        place, score = np.full(n, len(languages)), np.zeros(n)
        sets: list[list[str]] = [[] for _ in range(n)]
        shares: list[list[float]] = [[] for _ in range(n)]
        if languages and (full := np.flatnonzero(counts)).size:
            chosen, everything, _ = mixtures(words, counts[full], times)
            top = chosen.argmax(axis=0)
            for k, i in enumerate(full):
                if known[i]:
                    place[i], score[i] = top[k], min(1.0, float(everything[top[k], k]))
                    inside = np.argsort(-chosen[:, k], kind="stable")[: int((chosen[:, k] > 0).sum())]
                    sets[i], shares[i] = [languages[j] for j in inside], [float(chosen[j, k]) for j in inside]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).slice(start, n) for c in batch.schema.names if c != "text"), pa.array(names[place].tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
            [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "languages", "proportions"],
        )

    for batch in _slices(batches):
        texts = _lowered(batch.column("text"))
        known = pc.match_substring_regex(pc.fill_null(batch.column("text"), ""), r"\p{L}").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= size):
                held += len(texts[to])
                to += 1
            times = None
            if held > size and languages:  # one long text
                words, times = _long_scores(texts[at], logs, size)
                counts = np.array([words.shape[1]])
            else:
                words, counts = _word_scores(texts[at:to], logs)
            yield answer(at, to - at, known[at:to], words, counts, batch, times)
            at = to


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score, languages, proportions, one row for each of ``docs``.

    ``lang_pred`` has the largest share in the chosen set; ``score`` is its
    share when all languages compete.  Null texts, texts without a letter and all texts under a
    model of no language are ``und`` with score 0.  Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda batches: _predict_rows(batches, shared), f"{schema}, lang_pred string, score double, languages array<string>, proportions array<double>")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions: learned from the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), mod, 0).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = LanguageModel.fit(rows.where(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"])


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a recognised language, with all their columns; those that are ``und`` go."""
    model = LanguageModel.fit(docs.where(~held_out(F.col(id_col), 5, 0)), text_col, lang_col)
    renamed = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in renamed.items()], F.col(text_col).alias("text"))
    found = identify(rows, model, list(renamed.values())).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(n).alias(c) for c, n in renamed.items()])
