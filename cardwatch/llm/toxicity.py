"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed vectors of itself and of its beginnings, so endings
matter less. Filters of several widths run over the words of the whole text,
each keeps its maximum, and a logistic unit reads the maxima. After training,
vectors and filters fold into one table, so scoring is looking up and adding.
A start is trained on a bounded sample; if there are more labelled rows, rounds
over all of them follow: every task goes on from the same model over its own
rows, and the tasks' models are averaged. Thresholds count all rows kept apart.
Scores come from the text alone; only the threshold depends on the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from cardwatch.llm.words import MARKS, Words, in_batches, mix, slices
from cardwatch.session import remove, stage_at

BUCKETS, VECTOR, WIDTHS, FILTERS = 1 << 14, 16, (1, 2, 3), 8
#: Lengths in bytes of the beginnings that are hashed beside the word.
BEGINNINGS = (4, 6)
#: Bounds of the sample that the rounds start from, and of that which sets the start's bias, by label.
TRAIN_ROWS, CALIBRATE_ROWS = {1: 2000, 0: 3000}, {1: 1000, 0: 2000}
#: Parts in which that sample comes to the driver.
SAMPLE_PARTS = 16
#: Rounds over the labelled rows, at least and at most: as many as ``STEPS`` mini-batches take. Each is over one of so
#: many slices of the rows by hash. Rows of a task of a round at least, and the rate in it.
ROUNDS, SLICES, TASK_ROWS, ROUND_RATE = (4, 16), 2, 4000, 0.005
#: Scores are counted in so many bins for thresholds.
BINS = 1 << 16
STEPS, BATCH, RATE, DECAY = 600, 64, 0.01, 1e-4
#: Places of words whose gradients are taken at once; a mini-batch of longer texts is summed up in parts.
PLACES_AT_ONCE = 1 << 16
#: Bits of the map of labelled ids, for each of them and at most; a fuller map lets more other rows into the join.
ID_BITS, MOST_ID_BITS = 16, 1 << 26
#: A language needs so many rows of either label for a threshold of its own.
LEAST_ROWS = 20
_PADS = max(WIDTHS)


def _inputs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (kinds x places) with padding after each text; where each text's places begin and end."""
    n = words.counts()
    first = np.concatenate([[0], np.cumsum(np.maximum(n, 1) + _PADS)])  # a text without words has one empty place
    places = first[words.doc] + np.arange(len(words.start)) - words.first[words.doc]
    out = np.full((1 + len(BEGINNINGS), first[-1]), BUCKETS, np.uint16)
    for row, h in zip(out, words.prefix_hashes(*BEGINNINGS)):
        row[places] = (h % np.uint64(BUCKETS)).astype(np.uint16)
    return out, first[:-1], first[:-1] + np.maximum(n, 1)


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS + 1) x VECTOR, the last row stays zero
    filters: list[np.ndarray]  # of each width: width x VECTOR x FILTERS
    shift: np.ndarray  # widths x FILTERS
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(seed: int, prior: float) -> Model:
        r = np.random.default_rng(seed)
        vectors = r.normal(0, 0.1, (BUCKETS + 1, VECTOR)).astype(np.float32)
        vectors[-1] = 0
        return Model(
            vectors,
            [r.normal(0, (w * VECTOR) ** -0.5, (w, VECTOR, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros((len(WIDTHS), FILTERS), np.float32),
            r.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32),
            np.array([np.log(prior / (1 - prior))], np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters, self.shift, self.out, self.bias]

    def rows(self) -> np.ndarray:
        """All parameters in rows of ``VECTOR`` numbers, the vectors first."""
        flat = np.concatenate([p.ravel() for p in self.parameters()])
        return np.append(flat, np.zeros(-len(flat) % VECTOR, np.float32)).reshape(-1, VECTOR)

    def take_rows(self, rows: np.ndarray) -> None:
        flat, at = rows.astype(np.float32).ravel(), 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def table(self) -> np.ndarray:
        """Vectors through every filter place: (BUCKETS + 1) x (sum of widths * FILTERS)."""
        return np.concatenate([self.vectors @ f for filters in self.filters for f in filters], axis=1)


def _maxima(places: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = np.empty(2 * len(first), np.int64)
    at[0::2], at[1::2] = first, end
    return np.maximum.reduceat(places, at)[::2]


def score_words(words: Words, table: np.ndarray, shift: np.ndarray, out: np.ndarray, bias: float) -> np.ndarray:
    if not words.texts:
        return np.zeros(0)
    return score_places(*_inputs(words), table, shift, out, bias)


def score_places(buckets, first, end, table: np.ndarray, shift: np.ndarray, out: np.ndarray, bias: float) -> np.ndarray:
    x = table[buckets[0]]
    for kind in buckets[1:]:
        x += table[kind]
    logit, column = np.full(len(first), bias, np.float64), 0
    for k, width in enumerate(WIDTHS):
        total = x[: len(x) - width + 1, column : column + FILTERS].copy()
        for j in range(1, width):
            total += x[j : len(x) - width + 1 + j, column + j * FILTERS : column + (j + 1) * FILTERS]
        column += width * FILTERS
        logit += np.maximum(_maxima(total, first, end) + shift[k], 0) @ out[k]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _gradients(model: Model, buckets, first, end, labels, weights) -> list[np.ndarray]:
    """Sums over the texts given."""
    h = model.vectors[buckets[0]]
    for kind in buckets[1:]:
        h += model.vectors[kind]
    pooled, places = [], []
    for filters, shift in zip(model.filters, model.shift):
        width = len(filters)
        total = sum(h[j : len(h) - width + 1 + j] @ f for j, f in enumerate(filters)) + shift
        at = np.array([a + total[a:b].argmax(axis=0) for a, b in zip(first, end)])
        places.append(at)
        pooled.append(np.maximum(np.take_along_axis(total, at, axis=0), 0))
    logit = model.bias[0] + sum((p * o).sum(axis=1) for p, o in zip(pooled, model.out))
    wrong = ((1 / (1 + np.exp(-logit)) - labels) * weights).astype(np.float32)
    d_vectors, d_filters, d_shift = np.zeros_like(model.vectors), [], np.zeros_like(model.shift)
    d_out = np.stack([wrong @ p for p in pooled])
    for k, filters in enumerate(model.filters):
        back = wrong[:, None] * model.out[k] * (pooled[k] > 0)
        d_shift[k] = back.sum(axis=0)
        d = np.zeros_like(filters)
        for j, f in enumerate(filters):
            here = places[k] + j
            d[j] = np.einsum("nfv,nf->vf", h[here], back)
            into = back[:, :, None] * f.T[None]
            for kind in buckets:
                np.add.at(d_vectors, kind[here], into)
        d_filters.append(d)
    d_vectors[-1] = 0
    return [d_vectors, *d_filters, d_shift, d_out, np.array([wrong.sum()], np.float32)]


class Adam:
    """Steps down balanced cross-entropy; ``positive`` is the share of label 1."""

    def __init__(self, model: Model, positive: float, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.means = [np.zeros_like(p) for p in model.parameters()]
        self.squares = [np.zeros_like(p) for p in model.parameters()]
        self.weight = {1: 0.5 / max(positive, 1e-6), 0: 0.5 / max(1 - positive, 1e-6)}

    def step(self, inputs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """One mini-batch; returns which vectors it had a gradient for."""
        self.steps += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        total = None
        for part in _parts(range(len(inputs)), inputs):
            y = labels[part].astype(np.float32)
            given = _gradients(self.model, *_side_by_side([inputs[i] for i in part]), y, np.where(y > 0, self.weight[1], self.weight[0]) / len(inputs))
            total = given if total is None else [t + g for t, g in zip(total, given)]
        for p, g, m, s in zip(self.model.parameters(), total, self.means, self.squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= scale * (m / (np.sqrt(s) + 1e-8) + DECAY * p)
        return total[0].any(axis=1)


def train(inputs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """A start; ``inputs`` are the buckets of whole texts."""
    positive = float(labels.mean())
    model = Model.new(seed, min(max(positive, 0.05), 0.95))
    adam, order = Adam(model, positive), np.random.default_rng(seed)
    while adam.steps < STEPS:
        shuffled = order.permutation(len(inputs))
        for a in range(0, len(inputs), BATCH):
            batch = shuffled[a : a + BATCH]
            adam.step([inputs[i] for i in batch], labels[batch])
    return model


def _stored_inputs(buckets: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(1 + len(BEGINNINGS), -1) for x in buckets.to_pylist()]


_SUMS = [f"v{k}" for k in range(VECTOR)]


def _learned(shared, positive: float):
    """Of each task: the model's rows after its share of the table, times their weight.

    A vector weighs as many mini-batches as had a gradient for it, so tasks
    that never met its words do not hold it back; all else weighs by texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.new(0, 0.5)
        model.take_rows(shared.value)
        adam, weight = Adam(model, positive, ROUND_RATE), np.zeros(len(shared.value))
        inputs: list[np.ndarray] = []
        labels: list[int] = []

        def step() -> None:
            weight[: BUCKETS + 1] += adam.step(inputs, np.array(labels))
            weight[BUCKETS + 1 :] += len(inputs)
            inputs.clear()
            labels.clear()

        for batch in batches:
            for x, y in zip(_stored_inputs(batch.column("buckets")), batch.column("toxic").to_pylist()):
                inputs.append(x)
                labels.append(y)
                if len(inputs) == BATCH:
                    step()
        if inputs:
            step()
        at = np.flatnonzero(weight)
        sums = model.rows()[at].astype(np.float64) * weight[at, None]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at]), *(pa.array(c) for c in sums.T)], ["row", "weight", *_SUMS])

    return run


def train_on(model: Model, table: DataFrame, count: int, positive: float) -> None:
    """Rounds over all ``count`` rows of ``table`` (doc_id, toxic, buckets): models of the tasks, averaged by row of parameters.

    What reaches the driver is as large as the model, whatever the table.
    """
    kinds = "row int, weight double, " + ", ".join(f"{c} double" for c in _SUMS)
    slice_ = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(SLICES))
    tasks = max(1, count // SLICES // TASK_ROWS)
    for number in range(min(max(ROUNDS[0], -(-STEPS * BATCH * SLICES // count)), ROUNDS[1])):
        rows = model.rows()
        shared = table.sparkSession.sparkContext.broadcast(rows)
        part = in_batches(table).filter(slice_ == number % SLICES).select("toxic", "buckets").coalesce(tasks)
        sums = part.mapInArrow(_learned(shared, positive), kinds).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("weight", *_SUMS)]).toPandas()
        rows[sums["row"].to_numpy()] = sums[_SUMS].to_numpy() / sums["weight"].to_numpy()[:, None]
        model.take_rows(rows)
        shared.destroy()


def _side_by_side(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([x.shape[1] for x in inputs])
    first = np.cumsum(sizes) - sizes
    return np.concatenate(inputs, axis=1), first, first + sizes - _PADS


def _parts(which, inputs: list[np.ndarray]) -> Iterator[list[int]]:
    """Runs of ``which`` with a bounded number of places, one text at least."""
    part, places = [], 0
    for i in which:
        if part and places + inputs[i].shape[1] > PLACES_AT_ONCE:
            yield part
            part, places = [], 0
        part.append(i)
        places += inputs[i].shape[1]
    if part:
        yield part


def _scores(inputs: list[np.ndarray], arrays) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score_places(*_side_by_side([inputs[i] for i in part]), *arrays) for part in _parts(range(len(inputs)), inputs))])


def buckets_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets, hash) of each text; null counts as empty."""
    for _, _, words in slices(texts, apart=MARKS, most=1 << 18):
        buckets, first, end = _inputs(words)
        for a, b in zip(first.tolist(), (end + _PADS).tolist()):
            own = np.ascontiguousarray(buckets[:, a:b])
            yield own, int(np.bitwise_xor.reduce(mix(own[0].astype(np.uint64) + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(1 << 20))).view(np.int64))


def _threshold(scores: np.ndarray, toxic: np.ndarray, clean: np.ndarray | None = None) -> float:
    """The cut with the fewest errors; of several, the middle of the widest gap.

    ``toxic`` and ``clean`` are how many rows of either label have the score;
    without ``clean``, ``toxic`` is the label of one row.
    """
    order = np.argsort(scores, kind="stable")
    s, y, z = scores[order], toxic[order], (1 - toxic if clean is None else clean)[order]
    # Everything from place i on counts as toxic.
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(z[::-1])[::-1], [0]])
    low, high = np.concatenate([[0.0], s]), np.concatenate([s, [1.0]])
    best = np.lexsort((-(high - low), wrong))[0]
    return float(min(max((low[best] + high[best]) / 2, 0.05), 0.95))


def _logit(p):
    return np.log(p / (1 - p))


def _binned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(_stored_inputs(batch.column("buckets")), shared.value)
            bins = np.minimum((scores * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(bins)], ["lang", "toxic", "bin"])

    return run


def _cuts(shift: float):
    """Of one language's bins: its threshold for scores whose logits are less by ``shift``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        toxic, clean = pdf["toxic"].to_numpy(), pdf["clean"].to_numpy()
        cuts = [_threshold(1 / (1 + np.exp(shift - _logit((pdf["bin"].to_numpy() + 0.5) / BINS))), toxic, clean)] if min(toxic.sum(), clean.sum()) >= LEAST_ROWS else []
        return pd.DataFrame({"lang": pdf["lang"].iloc[: len(cuts)], "cut": cuts})

    return run


class Toxicity:
    """A trained classifier with its thresholds by language; ``default`` holds for all others."""

    def __init__(self, model: Model | None, prior: float, thresholds: dict[str, float], default: float = 0.5):
        self.prior, self.thresholds, self.default = prior, thresholds, default
        self.arrays = None if model is None else (model.table(), model.shift, model.out, float(model.bias[0]))

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
        """Train on ``docs`` (doc_id, text, lang) as ``labels`` (doc_id, toxic) marks them.

        The documents are scanned once; what goes on are the bucket numbers of
        all labelled texts, six bytes a word, in the shared folder. A fifth of
        the ids sets the thresholds, the rest trains. The start is trained in
        the driver on rows taken by a hash of their doc_id within the bounds
        above; there texts with equal buckets are one. If these are not all,
        ``train_on`` goes on over every training row. Bias and thresholds
        count every row of the other fifth, by score in ``BINS`` steps.
        Rows with another label or a null one are left out. Without documents
        of both labels every score is the share of toxic ones (0 without any).
        """
        spark = docs.sparkSession
        rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").distinct()
        fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(5))
        rows, rows_at = stage_at(rows.withColumn("trains", fold != 0), "toxicity-labels")
        parts = [(y, trains, n) for trains, most in ((True, TRAIN_ROWS), (False, CALIBRATE_ROWS)) for y, n in most.items()]

        def bounded(table: DataFrame, *order) -> DataFrame:
            return reduce(DataFrame.union, [table.filter((F.col("toxic") == y) & (F.col("trains") == trains)).orderBy(*order).limit(n) for y, trains, n in parts])

        # One scan of the documents; what goes on are bucket numbers of the labelled ones.
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        texts = in_batches(texts).filter(_perhaps_labelled(rows, rows.count()))
        read = texts.join(rows.hint("shuffle_hash"), "doc_id").select("doc_id", "toxic", "trains", "lang", "text")
        kinds = StructType([f for f in read.schema.fields if f.name != "text"])
        found = read.mapInArrow(_featured, StructType([*kinds.fields, StructField("hash", LongType()), StructField("buckets", BinaryType())]))
        found, found_at = stage_at(found, "toxicity-labelled")
        counts = {(r["trains"], r["toxic"]): r["count"] for r in found.groupBy("trains", "toxic").count().collect()}
        # The start's sample.
        chosen, chosen_at = stage_at(bounded(rows, F.xxhash64("doc_id"), "doc_id"), "toxicity-chosen")
        by = ["doc_id", "toxic", "trains"]
        own = found.join(F.broadcast(chosen), by).groupBy(*by, "hash").agg(F.min("lang").alias("lang"), F.first("buckets").alias("buckets"))
        own, own_at = stage_at(own, "toxicity-sample")
        least = own.groupBy(*by).agg(F.min("hash").alias("hash")).withColumn("more", F.lit(False))
        # One text of every id goes before further texts of any.
        ranked, ranked_at = stage_at(own.join(least, [*by, "hash"], "left").withColumn("more", F.coalesce("more", F.lit(True))), "toxicity-ranked")
        got = bounded(ranked, "more", F.xxhash64("doc_id", "hash"), "doc_id").select("doc_id", "toxic", "hash", "trains", "buckets")
        # A part at a time: at once, copies of the whole sample would lie in the driver's JVM side by side.
        got = sorted((tuple(r) for r in got.repartition(SAMPLE_PARTS, "doc_id").toLocalIterator()), key=lambda r: r[:3])
        for path in (rows_at, chosen_at, own_at, ranked_at):
            remove(spark, path)
        inputs = [np.frombuffer(r[4], np.uint16).reshape(1 + len(BEGINNINGS), -1) for r in got]
        trains, y = np.array([r[3] for r in got], bool), np.array([r[1] for r in got], np.int32)
        known, labels_held = y[trains], y[~trains]
        every = [counts.get((True, label), 0) for label in (0, 1)]
        positive = every[1] / max(sum(every), 1)
        if not len(known) or known.min() == known.max():
            remove(spark, found_at)
            return Toxicity(None, positive, {})
        model = train([x for x, t in zip(inputs, trains) if t], known)
        if sum(every) > len(known):
            if enough(labels_held):
                cut = _threshold(Toxicity(model, positive, {}).score([x for x, t in zip(inputs, trains) if not t]), labels_held)
                model.bias -= np.float32(_logit(cut))
            train_on(model, found.filter("trains"), sum(every), positive)
        out = Toxicity(model, positive, {})
        shared = spark.sparkContext.broadcast(out.arrays)
        binned = in_batches(found).filter("not trains").select("lang", "toxic", "buckets").mapInArrow(_binned(shared), "lang string, toxic int, bin int")
        binned = binned.groupBy("lang", "bin").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        binned, binned_at = stage_at(binned, "toxicity-bins")
        whole = binned.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).orderBy("bin").toPandas()
        if min(whole["toxic"].sum(), whole["clean"].sum()) >= LEAST_ROWS:
            shift = float(_logit(_threshold((whole["bin"].to_numpy() + 0.5) / BINS, whole["toxic"].to_numpy(), whole["clean"].to_numpy())))
            model.bias -= np.float32(shift)  # so that 0.5 is the cut over all languages
            cuts = binned.filter("lang is not null").groupBy("lang").applyInPandas(_cuts(shift), "lang string, cut double").collect()
            out = Toxicity(model, positive, {r["lang"]: r["cut"] for r in cuts})
        for path in (found_at, binned_at):
            remove(spark, path)
        return out

    def score(self, inputs: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given by their buckets."""
        return _scores(inputs, self.arrays)

    def scored(self, docs: DataFrame, score: str = "score", flag: str = "flagged") -> DataFrame:
        """``docs`` (text, lang and any others) with two columns after its own, which must not have these names.

        ``flag`` compares the score with the threshold of the row's lang.
        Null and empty texts get the score of no words; no row is dropped.
        """
        names = docs.columns
        kinds = StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(flag, BooleanType())])
        shared = docs.sparkSession.sparkContext.broadcast((self.arrays, self.prior, self.thresholds, self.default))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, prior, thresholds, default = shared.value
            for batch in batches:
                scores = [np.zeros(0)]
                if arrays is None:
                    scores.append(np.full(len(batch), prior))
                else:
                    scores += [score_words(w, *arrays) for _, _, w in slices(batch.column("text"), apart=MARKS, most=1 << 18)]
                found = np.concatenate(scores)
                cuts = np.array([thresholds.get(x, default) for x in batch.column("lang").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(found >= cuts)], [*names, score, flag])

        return in_batches(docs).mapInArrow(run, kinds)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = list(buckets_of(batch.column("text")))
            own = [batch.column(c) for c in ("doc_id", "toxic", "trains", "lang")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([h for _, h in found], pa.int64()), pa.array([x.tobytes() for x, _ in found], pa.binary())],
                ["doc_id", "toxic", "trains", "lang", "hash", "buckets"],
            )


def _perhaps_labelled(rows: DataFrame, count: int) -> Column:
    """Whether a row's doc_id may be one of ``rows``: never false for one that is, seldom true for another."""
    bits = 1 << max(min(ID_BITS * count, MOST_ID_BITS).bit_length() - 1, 6)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast(rows.schema["doc_id"].dataType)), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = rows.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("held")).toPandas()
    held = np.zeros(bits >> 6, np.int64)
    held[words["word"].to_numpy()] = words["held"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def known(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        return pd.Series(shared.value[p >> 6] >> (p & 63) & 1 == 1)

    return known(place)


def enough(labels: np.ndarray) -> bool:
    return min(labels.sum(), (1 - labels).sum()) >= LEAST_ROWS
