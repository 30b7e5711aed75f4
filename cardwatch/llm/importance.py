"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all
raw text, give each document the logarithm of their ratio. Documents are drawn
without replacement in proportion to it: Gumbel noise is added to the
logarithm, and the largest values are the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.words import Words, in_batches, mix, slices, span_hashes
from cardwatch.operators.positions import with_position

BUCKETS = 1 << 14
#: Share of the documents that is drawn.
KEEP = 0.9
#: The mean log ratio of an n-gram counts as that of so many.
SCALE = 100.0
_SMOOTH = 1.0


def _ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's n-grams, and their texts: words, pairs, word ends and pairs of ends."""
    w = words.hashes()
    tail = span_hashes(words.data, np.maximum(words.start, words.end - 3), words.end)[0]
    both = words.doc[1:] == words.doc[:-1]
    parts = [w, mix(tail + np.uint64(1)), mix(w[:-1] + mix(w[1:]))[both], mix(tail[:-1] + mix(tail[1:] + np.uint64(2)))[both]]
    docs = [words.doc, words.doc, words.doc[1:][both], words.doc[1:][both]]
    return (np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, words in slices(batch.column("text")):
            total += np.bincount(_ngrams(words)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets, counted over every row."""
    counts = np.full(BUCKETS, _SMOOTH)
    for row in texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] += row["n"]
    return np.log(counts / counts.sum())


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_ngrams, log_ratio, kept.

    The target is all documents that ``labels`` (doc_id, quality) marks 1, a text
    that one doc_id repeats counting once; the
    raw model counts all documents. ``log_ratio`` is the mean over a document's n-grams, 0 without
    any. The share ``keep`` of the rows with the largest noisy ratio is kept;
    the noise comes from the doc_id, so a run can be repeated, and ties go by
    doc_id. Null and empty texts and null ids take part like others. Without a
    target every ratio is 0. Other columns are not read; no rows give no rows.
    """
    texts = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    raw, target = _model(texts), _model(texts.join(good, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    ratio = target - raw if np.ptp(target) > 0 else np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in slices(batch.column("text")):
                buckets, owner = _ngrams(words)
                n = np.bincount(owner, minlength=words.texts)
                mean = np.bincount(owner, weights=shared.value[buckets], minlength=words.texts) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(mean)], ["doc_id", "n_ngrams", "log_ratio"])

    scored = texts.mapInArrow(score, "doc_id long, n_ngrams long, log_ratio double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = scored.withColumn("place", -(F.col("log_ratio") * SCALE - F.log(-F.log(uniform))))
    ranked = with_position(noisy, ["place", "doc_id"], out="rank", label="resample")
    rows = texts.count()
    return ranked.select("doc_id", "n_ngrams", "log_ratio", (F.col("rank") <= int(np.ceil(keep * rows))).alias("kept"))
