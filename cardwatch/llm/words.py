"""Words of a batch of texts as numpy arrays, cut and hashed without a loop over words.

A slice of texts is one byte array. Words are runs of bytes outside white space
(0x20, 0x09-0x0D), so multi-byte letters stay whole. A word's hash is a
polynomial of its bytes modulo 2**64, read off a running sum and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch at most: texts are long, and a worker holds a batch more than once.
BATCH_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes apart from ASCII letters, ASCII digits and other scripts.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones((2, 1), np.uint64)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Rows: powers of the base and of its inverse, ``n`` at least."""
    global _powers
    if _powers.shape[1] < n:
        grown = np.ones((2, max(n, SLICE_BYTES + 1)), np.uint64)
        grown[0, 1:], grown[1, 1:] = _BASE, _BASE_INV
        _powers = np.multiply.accumulate(grown, axis=1)
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the spans from ``start`` to each of ``ends`` in numbers of up to 64 bits."""
    p = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[0, : len(data)], out=sums[1:])
    return [mix((sums[e] - sums[start]) * p[1, start] + (e - start).astype(np.uint64)) for e in ends]


@dataclass
class Words:
    """Words of some texts, in order. ``doc``: index of the text of each word; ``first``: index of each text's first word; ``offsets``: the texts' bytes."""

    data: np.ndarray
    texts: int
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        return self.prefix_hashes()[0]

    def prefix_hashes(self, *lengths: int) -> list[np.ndarray]:
        """Hashes of the words, and of their first bytes, so many or all there are."""
        ends = [self.end, *(np.minimum(self.start + n, self.end) for n in lengths)]
        return span_hashes(self.data, self.start, *ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cut(data: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = SPACE) -> Words:
    """Words of the texts that lie between ``offsets`` in ``data``."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], np.asarray(offsets, np.int64) - base
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(apart[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets] = inside[offsets]  # a text's end ends a word
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(LOWER[data] if lower else data, len(offsets) - 1, start, end, doc, first, offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES, apart: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of rows of bounded size."""
    data, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j, cut(data, at[i : j + 1], lower, apart)
        i = j


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's runs of ``width`` words; a shorter text with words is one run."""
    w, count = words.hashes(), words.counts()
    n = len(w)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        odd = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1) + 2 * j) & ((1 << 64) - 1) | 1)
        out[: max(0, n - j)] += w[j:] * odd
    left = words.first[1:][words.doc] - np.arange(n)
    whole = left >= width
    short = np.flatnonzero((count > 0) & (count < width))
    hashes, docs = mix(out[whole]), words.doc[whole]
    if len(short):
        # The sum over fewer words, apart from any full run.
        tail = [mix(np.array([np.sum(w[a:b] * np.arange(1, 2 * (b - a), 2, dtype=np.uint64), dtype=np.uint64)], np.uint64) + np.uint64(b - a))[0] for a, b in zip(words.first[short], words.first[short + 1])]
        hashes, docs = np.concatenate([hashes, np.array(tail, np.uint64)]), np.concatenate([docs, short])
    return hashes, docs


def distinct_per_text(hashes: np.ndarray, docs: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in rising order, and where each text's part begins."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(texts + 1))
