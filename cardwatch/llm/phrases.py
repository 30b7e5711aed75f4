"""Phrase collocations: word sequences that are commoner than their parts suggest.

Every place of a text where a phrase can start is a suffix pointer: the next
four words. Suffixes are routed by their leading words into ranges of the whole
corpus, and a range is sorted by multikey three-way quicksort: pointers are
parted by one word into less, equal and greater. The size of an equal part is
the count of the words so far; a part too small to hold a frequent phrase is
abandoned. A phrase whose pointers lie in several ranges is at the edge of each
of them, and only such counts are added up.

Two passes before it leave fewer pointers. Words, then pairs of words, are
counted, and fixed-size bit maps of the frequent ones say where no frequent
phrase can start or go on. A bit that two words share keeps a pointer too many
and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwatch.llm.words import Words, in_batches, mix, slices
from cardwatch.session import remove, stage_at

#: Words of a phrase at most.
DEPTH = 4
#: Occurrences of a candidate at least.
LEAST = 30
#: A phrase goes if a longer one around it has such a share of its occurrences (per cent).
INSIDE = 80
#: Phrases of a language that are returned.
TOP = 2000
#: Score of a phrase whose parts never occur without it.
SCALE = 1_000_000
NO_LANG = "und"
#: Bits of the maps: 1 MB of words, 4 MB of pairs, at every size of the corpus.
WORD_BITS, PAIR_BITS = 23, 25
#: Distinct entries that a task counts before it hands them on.
HELD = 1 << 20
#: Pointers in a range, about.
RANGE_ROWS = 1 << 20

#: Bytes that end a piece, and those that lie between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True

_KEYS = [f"w{k}" for k in range(1, DEPTH + 1)]
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _language_salts(column: pa.Array) -> np.ndarray:
    langs = column.dictionary_encode()
    salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)
    return salts[langs.indices.to_numpy(zero_copy_only=False)] if len(salts) else np.zeros(0, np.uint64)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(first row, words, word ids, whether the next word follows in the same piece) of parts of a batch."""
    salts = _language_salts(batch.column("lang"))
    for i, _, words in slices(batch.column("text"), apart=APART):
        breaks = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(BREAK[words.data], out=breaks[1:])
        follows = np.zeros(len(words.start), bool)
        follows[:-1] = (words.doc[1:] == words.doc[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
        yield i, words, mix(words.hashes() ^ salts[words.doc + i]), follows


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    size = words.end[which] - words.start[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = words.data[np.arange(ends[-1]) + np.repeat(words.start[which] - ends[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends), pa.py_buffer(data))


class _Tally:
    """Counts by key over the batches of a task; ``add`` and ``rest`` yield them whenever many are held."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, key: np.ndarray, n: np.ndarray, *others: pa.Array) -> Iterator[tuple]:
        self.parts.append((key, n, *others))
        self.rows += len(key)
        if self.rows >= 2 * HELD:
            self._fold()
            if self.rows >= HELD:
                yield from self.rest()

    def _fold(self) -> None:
        key, first, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, at, np.concatenate([p[1] for p in self.parts]))
        others = [pa.concat_arrays(list(x)).take(pa.array(first)) for x in zip(*[p[2:] for p in self.parts])]
        self.parts, self.rows = [(key, n, *others)], len(key)

    def rest(self) -> Iterator[tuple]:
        if self.parts:
            self._fold()
            yield self.parts[0]
        self.parts, self.rows = [], 0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, id, word, n) of the words, and a row of no word with the sum of each language."""
    names = ["lang", "id", "word", "n"]

    def out(key, n, word, lang):
        return pa.RecordBatch.from_arrays([lang, pa.array(key.view(np.int64)), word.cast(pa.string()), pa.array(n)], names)

    tally, sums = _Tally(), {}
    for batch in batches:
        langs = batch.column("lang")
        for i, words, ids, _ in _read(batch):
            key, first, n = np.unique(ids, return_index=True, return_counts=True)
            lang = langs.take(pa.array(words.doc[first] + i))
            for part in tally.add(key, n, _strings(words, first), lang):
                yield out(*part)
            for name, count in zip(langs.slice(i, words.texts).to_pylist(), words.counts().tolist()):
                sums[name] = sums.get(name, 0) + count
    for part in tally.rest():
        yield out(*part)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([0] * len(sums), pa.int64()), pa.array([""] * len(sums)), pa.array(list(sums.values()), pa.int64())], names)


def _bits(ids: DataFrame, bits: int) -> np.ndarray:
    """The bit map of column ``id``: one row per 64 bits at most comes to the driver."""
    place = F.col("id").bitwiseAND((1 << bits) - 1)
    rows = (
        ids.groupBy(F.shiftright(place, 6).alias("at"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id & {63} as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_map(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = ids & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _pairs(ids: np.ndarray, follows: np.ndarray, words_map: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a frequent word follows another one, and the ids of such pairs."""
    often = _in_map(ids, words_map)
    both = follows & often
    both[:-1] &= often[1:]
    at = np.flatnonzero(both)
    return at, mix(ids[at] * _PAIR + ids[np.minimum(at + 1, len(ids) - 1)])


def _pair_counts(words_map):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["id", "n"])

        for batch in batches:
            for _, _, ids, follows in _read(batch):
                _, pairs = _pairs(ids, follows, words_map.value)
                for part in tally.add(*np.unique(pairs, return_counts=True)):
                    yield out(*part)
        for part in tally.rest():
            yield out(*part)

    return run


def _suffixes(words_map, pairs_map):
    """Pointers where a phrase can start, as ids of the words it can go on with (0: none), with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def out(key, n, *columns):
            return pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*_KEYS, "n"])

        for batch in batches:
            for _, _, ids, follows in _read(batch):
                at, pairs = _pairs(ids, follows, words_map.value)
                goes = np.zeros(len(ids) + DEPTH, bool)
                goes[at[_in_map(pairs, pairs_map.value)]] = True
                at = np.flatnonzero(goes)
                padded = np.concatenate([ids, np.zeros(DEPTH, np.uint64)])
                suffix, on = [padded[at]], np.ones(len(at), bool)
                key = suffix[0].copy()
                for k in range(1, DEPTH):
                    on &= goes[at + k - 1]
                    suffix.append(np.where(on, padded[at + k], np.uint64(0)))
                    key = mix(key * _PAIR + suffix[k])
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                for part in tally.add(key[first], n, *[pa.array(s[first].view(np.int64)) for s in suffix]):
                    yield out(*part)
        for part in tally.rest():
            yield out(*part)

    return run


def _edges(words: np.ndarray, n: np.ndarray) -> dict[tuple, int]:
    """Counts of the leading words of the least and of the greatest pointer."""
    out = {}
    for pick in (np.min, np.max):
        rows = np.arange(len(n))
        for depth in range(DEPTH):
            word = pick(words[depth][rows])
            if word == 0 and depth:
                break
            rows = rows[words[depth][rows] == word]
            out[tuple(int(x) for x in words[: depth + 1, rows[0]])] = int(n[rows].sum())
    return out


def frequent_prefixes(words: np.ndarray, n: np.ndarray, least: int) -> list[tuple[tuple, int]]:
    """(leading words, count) of at least ``least`` pointers, two words or more.

    ``words``: a row for each depth, 0 after a pointer's end; ``n``: how often
    each pointer occurs. Multikey three-way quicksort to the full depth.
    """
    out = []
    stack = [(np.arange(len(n)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or n[rows].sum() < least:
            continue  # no part of it can be frequent
        column = words[depth][rows]
        pivot = np.partition(column[[0, len(rows) // 2, -1]], 1)[1]
        low, high = column < pivot, column > pivot
        stack.append((rows[low], depth))
        stack.append((rows[high], depth))
        same = rows[~(low | high)]
        count = int(n[same].sum())
        if pivot == 0 or count < least:
            continue
        if depth:
            out.append((tuple(int(x) for x in words[: depth + 1, same[0]]), count))
        if depth + 1 < DEPTH:
            stack.append((same, depth + 1))
    return out


def _sorted_range(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        words = np.stack([np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in _KEYS])
        n = np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b in held])
        del held
        found = {p: c for p, c in _edges(words, n).items() if len(p) > 1}
        found.update(frequent_prefixes(words, n, least))  # the same counts where both have one
        rows = np.zeros((DEPTH, len(found)), np.int64)
        for i, phrase in enumerate(found):
            rows[: len(phrase), i] = phrase
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(list(found.values()), pa.int64())], [*_KEYS, "n"])

    return run


@contextmanager
def _sent(spark: SparkSession, value):
    """``value`` on every executor while it is used."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


_SUFFIX = ", ".join(f"{c} long" for c in [*_KEYS, "n"])


def _counts(docs: DataFrame, least: int, staged) -> tuple[DataFrame, DataFrame]:
    """(lang, id, word, n) of frequent words and the sums, (w1.., n) of frequent phrases."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(_word_counts, "lang string, id long, word string, n long").groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))
    words = staged(counted.filter((F.col("n") >= least) | (F.col("word") == "")), "phrase-words")
    with _sent(spark, _bits(words.filter("word != ''"), WORD_BITS)) as words_map:
        pairs = docs.mapInArrow(_pair_counts(words_map), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        with _sent(spark, _bits(pairs, PAIR_BITS)) as pairs_map:
            suffixes = staged(docs.mapInArrow(_suffixes(words_map, pairs_map), _SUFFIX), "phrase-suffixes")
    ranges = suffixes.count() // RANGE_ROWS + 1
    ranged = suffixes.repartitionByRange(ranges, *_KEYS).mapInArrow(_sorted_range(least), _SUFFIX)
    phrases = ranged.groupBy(*_KEYS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, staged(phrases, "phrase-counts")


def _words_of(columns: list[Column]) -> list[Column]:
    return [*columns, *[F.lit(0).cast("long")] * (DEPTH - len(columns))]


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The best phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z in lower case; ``.,;:!?`` and line ends part pieces, spaces
    and tabs words. A phrase is two to four words of a piece with ``a`` >=
    ``least`` occurrences in the language, overlaps included. Of its cuts in
    two, the one with the least score counts, and of equal ones the first;
    ``l`` and ``r`` are the occurrences of its parts, ``n`` all words of the
    language, ``score`` floor(2 * SCALE * a / (l + r)). A phrase within a longer
    candidate that has ``inside`` per cent of its occurrences goes. The first
    ``top`` by score, occurrences and phrase are returned.

    A null language is ``und``; null and empty texts have no words; a repeated
    row counts each time; other columns are not read. An empty table gives no
    rows. Words are told apart by 64-bit hashes. A text is read whole, of any
    length; a task holds one slice of texts and two million counts at most.
    """
    paths: list[str] = []

    def staged(df: DataFrame, label: str) -> DataFrame:
        table, path = stage_at(df, label)
        paths.append(path)
        return table

    docs = in_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    words, phrases = _counts(docs, least, staged)
    names = words.filter("word != ''").select("id", "lang", "word", "n")
    ones = names.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(c) for c in _KEYS[1:]], "n")
    every = ones.union(phrases.select(*_KEYS, "n"))

    def part(name: str, parts: list[Column]) -> Column:
        return F.struct(*[x.alias(f"{name}{k}") for k, x in zip(range(1, DEPTH + 1), _words_of(parts))])

    w = [F.col(c) for c in _KEYS]
    length = sum((F.col(c) != 0).cast("int") for c in _KEYS)
    cuts, held = [], []
    for size in range(2, DEPTH + 1):
        for k in range(1, size):
            cut = F.struct(F.lit(k).alias("k"), part("l", w[:k]).alias("left"), part("r", w[k:size]).alias("right"))
            cuts.append(F.when(F.col("size") == size, cut))
        for inner in range(2, size):
            held += [F.when(F.col("size") == size, part("w", w[k : k + inner])) for k in range(size - inner + 1)]
    sized = phrases.withColumn("size", length)
    cut = sized.select(*_KEYS, F.col("n").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("cut")).select(*_KEYS, "a", "cut.k", "cut.left.*", "cut.right.*")
    for side in ("l", "r"):
        cut = cut.join(every.toDF(*[f"{side}{k}" for k in range(1, DEPTH + 1)], side), [f"{side}{k}" for k in range(1, DEPTH + 1)])
    wide = lambda c: c.cast("decimal(19,0)")
    twice = wide(F.lit(2 * SCALE)) * wide(F.col("a"))
    cut = cut.withColumn("twice", twice).withColumn("both", wide(F.col("l")) + wide(F.col("r"))).withColumn("score", F.expr("twice div both"))
    best = cut.groupBy(*_KEYS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = (
        sized.filter("size > 2")
        .select("n", F.explode(F.array_compact(F.array(*held))).alias("w"))
        .groupBy(*[F.col(f"w.{c}").alias(c) for c in _KEYS])
        .agg(F.max("n").alias("longest"))
    )
    free = best.join(longer, _KEYS, "left").filter(~F.coalesce(wide(F.col("longest")) * 100 >= wide(F.col("a")) * inside, F.lit(False)))
    for k, c in enumerate(_KEYS):
        look = names.select(F.col("id").alias(c), F.col("word").alias(f"s{k}"), *([F.col("lang")] if k == 0 else []))
        free = free.join(look, c, "inner" if k < 2 else "left")
    total = words.filter("word = ''").select("lang", F.col("n").alias("n"))
    phrase = F.concat_ws(" ", *[f"s{k}" for k in range(DEPTH)])
    rows = free.select("lang", phrase.alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    out = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    result, _ = stage_at(out, "phrases")
    for path in paths:
        remove(docs.sparkSession, path)
    return result
