"""Quality rules with line frequencies across documents.

A line's words, in lower case, make its hash. Lines that too many documents of
one host hold are boilerplate: they are taken out, and a document of which too
little is left is rejected. Rules on a text alone reject as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.words import LOWER, Words, in_batches, mix, slices, span_hashes
from cardwatch.session import stage

#: Rules on a text alone.
LEAST_WORDS, REPEAT_WINDOW = 50, 3
#: A line is common that more than so many documents of a host hold, however large the host is. A share of the host is not asked.
LINE_DOCUMENTS, LINE_SHARE = 20, 0.0
#: Share of its words that a document must keep, beside ``LEAST_WORDS``.
LEFT = 0.5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "array<struct<number:int,hash:long,words:int>>"


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _repeats(words: Words) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    h, n = words.hashes(), len(words.start)
    left = words.first[1:][words.doc] - np.arange(n)
    at = np.flatnonzero(left >= REPEAT_WINDOW)
    total = mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(REPEAT_WINDOW):
        total = mix(total + h[at + k])
    _, where, times = np.unique(total, return_inverse=True, return_counts=True)
    inside = np.zeros(n, bool)
    for k in range(REPEAT_WINDOW):
        inside[at[times[where] > 1] + k] = True
    return _per_text(inside, words.first)


def _lines(words: Words) -> tuple[np.ndarray, ...]:
    """Of each line with a word: its text, number there, first word and the one after its last, first byte and end."""
    breaks = np.flatnonzero(words.data == 10)
    after = np.searchsorted(breaks, words.start)  # the next line break of each word
    new = np.ones(len(after), bool)
    new[1:] = (after[1:] != after[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    text, brk = words.doc[first], after[first]
    edges = np.concatenate([[-1], breaks, [len(words.data)]])
    begin = np.maximum(edges[brk] + 1, words.offsets[text])
    end = np.minimum(edges[brk + 1], words.offsets[text + 1])
    number = brk - np.searchsorted(breaks, words.offsets[text])
    return text, number, first, np.append(first[1:], len(after)), begin, end


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column("text"), lower=False):
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
            text, number, a, b, begin, end = _lines(words)
            exact = mix(span_hashes(words.data, begin, end)[0] + mix(text.astype(np.uint64)))
            _, once = np.unique(exact, return_index=True)
            again = np.ones(len(text), bool)
            again[once] = False
            at = np.searchsorted(text, np.arange(words.texts + 1))
            low = replace(words, data=LOWER[words.data]).hashes()
            loose = span_hashes(low, a, b)[0].view(np.int64)
            lines = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(loose), pa.array(b - a, pa.int32())], ["number", "hash", "words"])
            stats = [words.counts(), np.diff(chars[words.first]), _per_text(_SYMBOLS[words.data], words.offsets), _per_text(again, at), _repeats(words)]
            columns = [x.slice(i, j - i) for x in (batch.column("doc_id"), batch.column("host"))]
            columns += [*(pa.array(x, pa.int64()) for x in stats), pa.ListArray.from_arrays(pa.array(at, pa.int32()), lines)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", *(x.split()[0] for x in _STATS.split(", ")), "lines"])


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and ``host``).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, common_lines, words_left, kept.
    ``common_lines`` numbers the lines (from 0) that are common at the host;
    ``cut_lines`` takes them out of the text. ``base_failed`` is true under 50
    words, or if over half of them lie in repeated windows of three. Of other
    documents those lose ``kept`` that common lines leave under 50 words or
    half of their words.

    A document counts once for a line, each row being a document. Lines
    without a word are none. A null host is a host of its own; null and empty
    texts have no words and fail. Other columns are not read; an empty table
    gives no rows.
    """
    given = in_batches(docs).select(F.col("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    measured = stage(given.mapInArrow(_measured, f"doc_id {kind}, host string, {_STATS}, lines {_LINES}").withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = measured.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    once = measured.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.hash))).alias("hash"))
    common = (
        once.groupBy("host", "hash").agg(F.count("*").alias("held"))
        .filter(F.col("held") > LINE_DOCUMENTS)
        .select(F.col("host").alias("h"), F.col("hash").alias("k"))
    )
    # The same hash of a null host meets the null host only.
    found = (
        lines.join(common, (F.col("hash") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("number")).alias("common_lines"), F.sum("words").alias("taken"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("taken", F.lit(0))
    depleted = F.col("taken").isNotNull() & ((left < LEAST_WORDS) | (left < LEFT * F.col("n_words")))
    return measured.join(found, "row", "left").select(
        "doc_id", *(x.split()[0] for x in _STATS.split(", ")), failed.alias("base_failed"),
        F.coalesce("common_lines", F.array().cast("array<int>")).alias("common_lines"), left.alias("words_left"),
        (~failed & ~depleted).alias("kept"),
    )


def cut_lines(text: Column, numbers: Column) -> Column:
    """``text`` without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(numbers, i)), "\n")
