"""Word and shingle hashes of whole batches of texts, without a Python loop.

A batch is one byte buffer with document offsets. Words are runs of bytes other
than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is its polynomial
modulo 2**64 with an odd base, taken from one prefix sum over the buffer, and
then mixed; a shingle's hash mixes the weighted sum of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


#: Weights of a shingle's words: unrelated odd numbers, as those in a row
#: (c, 3c, 5c, ...) let words change places.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Batch(NamedTuple):
    """Words of consecutive documents; ``first[d]:first[d + 1]`` are those of d."""

    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray  # word offsets of documents, one more than documents
    hash: np.ndarray


def text_chunks(texts: pa.Array, limit: int = 1 << 19, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows whose texts hold about ``limit`` bytes; a
    longer text stands alone."""
    offsets = _offsets(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def as_strings(texts: pa.Array) -> pa.Array:
    """Texts as one string array without nulls (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def words_of(texts: pa.Array) -> Batch:
    """Words of a chunk (an array from ``as_strings``, sliced)."""
    offsets = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = (offsets - offsets[0]).astype(np.int64)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Batch(z, z, np.zeros(len(texts) + 1, np.int64), z.astype(np.uint64))
    space = _IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a document begins or ends here
    edge[bounds] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(raw))
    terms = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)]
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(terms, out=prefix[1:])
    word = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return Batch(start, end, np.searchsorted(start, bounds), word)


def shingles_of(batch: Batch, width: int = SHINGLE, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of each document, and offsets per
    document. ``whole``: a document with fewer words, but some, has one shingle,
    its whole word sequence; else it has none."""
    n = np.diff(batch.first)
    w = batch.hash
    total = np.zeros(len(w), np.uint64)
    for j in range(width):
        total[: max(len(w) - j, 0)] += w[j:] * _PLACES[j]
    counts = np.where(n >= width, n - width + 1, 0)
    short = (n > 0) & (n < width) & whole
    # positions of windows: all word positions but the last width - 1 of each document
    keep = np.ones(len(w), bool)
    for j in range(1, width):
        at = batch.first[1:] - j
        keep[at[at >= batch.first[:-1]]] = False
    for d in np.flatnonzero(short):  # a few words at most
        a, b = int(batch.first[d]), int(batch.first[d + 1])
        value = sum(int(x) * int(_PLACES[j]) for j, x in enumerate(w[a:b]))
        total[a] = np.uint64((value + (b - a) * 0xA0761D6478BD642F) & (2**64 - 1))
        keep[a] = True
        counts[d] = 1
    return mix(total[keep]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
