"""Hashed sets of word shingles, computed on Arrow buffers with numpy.

Words lie between ASCII white space after lower-casing A-Z; a shingle is five
consecutive words.  A text of fewer words, but not none, is one shingle of all
its words.  Whole texts are read; working memory follows ``CHUNK_BYTES`` and, for
a longer text, the number of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        del _powers[:-2]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, place of every word's first byte); no word crosses the start of a text."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    octets = _ASCII_LOWER[data]
    inside = ~_BLANK[octets]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts_of_texts[starts_of_texts < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * inverse[begin]), begin


def _join(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    h = hashes[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(_BASE) + hashes[k : k + n]
    return _mix(h + np.uint64(width))


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text beyond the chunk size, block by block."""
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data):  # up to the last blank, or on to the next one if a word is longer than a block
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            end = min(end + CHUNK_BYTES, len(data))
        found.append(word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(found)


def _set_of(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(_join(words, min(SHINGLE, len(words))).view(np.int64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string array without nulls."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        if to <= at:
            yield _set_of(_long_text(data[offsets[at] : offsets[at + 1]]))
            at += 1
            continue
        to = min(to, len(texts))
        local = offsets[at : to + 1] - offsets[at]
        hashes, begin = word_hashes(data[offsets[at] : offsets[to]], local[:-1])
        cuts = np.searchsorted(begin, local)
        for k in range(to - at):
            yield _set_of(hashes[cuts[k] : cuts[k + 1]])
        at = to


def _list_array(sets: list[np.ndarray]) -> pa.Array:
    lengths = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of consecutive rows with about a million hashes together: (first row, sets)."""
    start, held, run = 0, 0, []
    for k, s in enumerate(shingle_sets(batch.column("text"))):
        run.append(s)
        held += len(s)
        if held > 1 << 18:
            yield start, run
            start, held, run = k + 1, 0, []
    if run:
        yield start, run


def sketch_rows(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """The columns but text, then n, sig, sketch: set size, digest of the set and its k least hashes (None: all of them)."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for start, sets in _grouped(batch):
            n = pa.array([len(s) for s in sets], pa.int64())
            sig = pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets], pa.binary())
            kept = [batch.column(c).slice(start, len(sets)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, n, sig, _list_array([s[:k] for s in sets])], [*others, "n", "sig", "sketch"])
