"""Packing of tokenized documents into sequences by a grouping genetic algorithm.

Documents become token ids and an end id; only longer ones than a sequence are
cut. Whole pieces are sequences of their own. The others are dealt into blocks
of bounded size, and each block is packed by islands: small populations in
which a child takes whole well-filled sequences of one parent into the other,
drops the sequences that now hold copies, and places what they held by best
fit. Between epochs each island passes its best packing to the next one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.merges import merges_of
from cardwatch.llm.words import in_batches
from cardwatch.session import stage

LENGTH, END_ID = 2048, 0
#: Pieces in a block, islands of a block, packings of an island, epochs, children of an epoch.
BLOCK_ROWS, ISLANDS, POPULATION, EPOCHS, CHILDREN = 4096, 3, 4, 3, 6
#: Words in each of the two generations that a worker keeps the ids of, and letters of a kept word at most.
KEPT_WORDS, KEPT_LETTERS = 100_000, 64
#: Groups of the genetic algorithm are dealt to so many tasks at most.
GROUP_TASKS = 10_000
#: Texts tokenized at once, in bytes.
SLICE_BYTES = 1 << 20
#: Words that the tokenizer is given at once; its results are large.
ENCODED_WORDS = 4096
#: Different words that are merged in step at most.
MERGED_PARTS = 1 << 18


class Memory:
    """Ids of words met lately: a word that is asked for again moves to the young generation, and a full one ages."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, words: set[str]) -> dict[str, bytes]:
        found = {w: self.young[w] for w in words.intersection(self.young)}
        again = {w: self.old[w] for w in words.intersection(self.old).difference(found)}
        self.keep(again)
        return found | again

    def keep(self, made: dict[str, bytes]) -> None:
        for w, ids in made.items():
            if len(w) <= KEPT_LETTERS:
                self.young[w] = ids
                if len(self.young) >= KEPT_WORDS:
                    self.young, self.old = {}, self.young


_kept: dict[str, Memory] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never reads across it, so a text's ids
    are those of its parts between spaces. Each different part of ``texts`` is
    encoded once, all of them together.
    """
    if not texts:
        return []
    texts = [t.replace("\n", " ") for t in texts]
    parts = np.array([t.count(" ") + 1 for t in texts])
    data = " ".join([*texts, ""]).encode()
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1
    # A part keeps the space after it, so that parts lie side by side as Arrow wants them.
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    ids, size = _part_ids(coded.dictionary, path)
    begin = np.cumsum(size) - size
    code = coded.indices.to_numpy()
    n = size[code]
    upto = np.concatenate(([0], np.cumsum(n)))
    raw = ids[np.arange(upto[-1]) + np.repeat(begin[code] - upto[:-1], n)].tobytes()
    cut = (4 * upto[np.concatenate(([0], np.cumsum(parts)))]).tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def _part_ids(parts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different parts, each with a space after it, one part after the other, and how many each has."""
    merges, begin = merges_of(path), np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2], np.uint8)
    got, sizes = [], []
    for k in range(0, len(parts), MERGED_PARTS):
        at = begin[k : k + MERGED_PARTS + 1]
        if merges is None:
            done, ids, size = np.zeros(len(at) - 1, bool), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
        else:
            done, ids, size = merges.plain(data[at[0] : at[-1]], at[:-1] - at[0], np.diff(at) - 1)
        rest = np.flatnonzero(~done)
        others = [w[:-1] for w in parts.take(pa.array(k + rest)).to_pylist()]
        known = _library_ids(others, path)
        size[rest] = [len(known[w]) // 4 for w in others]
        mine = np.repeat(done, size)
        flat = np.empty(len(mine), "<u4")
        flat[mine], flat[~mine] = ids, np.frombuffer(b"".join([known[w] for w in others]), "<u4")
        got.append(flat)
        sizes.append(size)
    return np.concatenate(got), np.concatenate(sizes)


def _library_ids(words: list[str], path: str) -> dict[str, bytes]:
    """Ids of parts without a space; those met before are looked up."""
    if not words:
        return {}
    tokenizer, memory = _tokenizer(path), _kept.setdefault(path, Memory())
    pairs = {w: _stem(w) for w in words}
    stems = {x for pair in pairs.values() for x in pair}
    ids = memory.recall(stems)
    new = list(stems.difference(ids))
    made = {}
    for k in range(0, len(new), ENCODED_WORDS):
        part = new[k : k + ENCODED_WORDS]
        # As one text with spaces between: a call for each word costs more than its letters.
        got = tokenizer.encode(" ".join(part), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in part)])
        cut = np.searchsorted([a for a, _ in got.offsets], begins).tolist()
        raw = np.array(got.ids, "<u4").tobytes()
        made.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cut, cut[1:]))
    memory.keep(made)
    ids |= made
    return {w: ids[stem] + ids[mark] for w, (stem, mark) in pairs.items()}


def _stem(word: str) -> tuple[str, str]:
    """A word in the letters that the tokenizer sees, and the mark after its last letter, which is a token of its own."""
    if "<" in word or len(word) < 2:
        return word, ""
    if word.isascii():
        word = word.lower()
        if word[-1] not in ",.":
            return word, ""
    last = word[-2]
    # Beyond these scripts, and in one of their letters, the lower-case or composed form may end in a mark.
    plain = last < "\u0180" and last != "\u0130" and last.isalpha()
    return (word[:-1], word[-1]) if plain and word[-1] in ",." else (word, "")


def _pieces(path: str, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").fill_null("").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_BYTES):
                    size += len(texts[b])
                    b += 1
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, tokens in enumerate(token_ids(texts[a:b], path)):
                    tokens += np.uint32(END_ID).tobytes()
                    for k, at in enumerate(range(0, len(tokens), 4 * LENGTH)):
                        part = tokens[at : at + 4 * LENGTH]
                        row.append(a + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            raw.append(part)
                columns = [ids.take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if keep_ids else [])], names)
                a = b

    return run


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, room: np.ndarray, next_bin: int, out: np.ndarray) -> int:
    """Put ``items`` in turn where they leave the least room; opens bins from ``next_bin`` on, and returns the first unused one."""
    free = sorted(zip(room.tolist(), bins.tolist()))
    for i, size in zip(items.tolist(), lengths[items].tolist()):
        at = bisect_left(free, (size, -1))
        if at == len(free):
            left, bin_ = LENGTH - size, next_bin
            next_bin += 1
        else:
            left, bin_ = free.pop(at)
            left -= size
        out[i] = bin_
        if left:
            insort(free, (left, bin_))
    return next_bin


def _decreasing(lengths: np.ndarray, noise: float, r: np.random.Generator) -> np.ndarray:
    order = np.argsort(-(lengths * (1 + noise * r.random(len(lengths)))), kind="stable")
    out = np.empty(len(lengths), np.int32)
    best_fit(lengths, order, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, out)
    return out


def fitness(lengths: np.ndarray, packing: np.ndarray) -> tuple[int, float]:
    """Sequences used, then how unevenly they are filled (the fuller the full ones, the better); smaller is better."""
    fill = np.bincount(packing, weights=lengths)
    return len(fill), -float(np.square(fill / LENGTH).sum())


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, r: np.random.Generator) -> np.ndarray:
    fill = np.bincount(other, weights=lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.25))
    taken = np.zeros(len(fill), bool)
    taken[good[r.random(len(good)) < r.uniform(0.1, 0.6)]] = True
    moved = taken[other]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[moved]] = True
    # Beside those with copies, the emptiest sequences open as well.
    rest = np.bincount(one, weights=lengths)
    broken[np.argsort(rest)[: 1 + r.integers(3)]] = True
    loose = broken[one] & ~moved
    child = np.where(moved, len(broken) + other, one).astype(np.int64)
    placed = np.flatnonzero(~loose)
    used, where = np.unique(child[placed], return_inverse=True)
    out = np.empty(len(one), np.int32)
    out[placed] = where
    room = LENGTH - np.bincount(where, weights=lengths[placed], minlength=len(used)).astype(np.int64)
    open_ = np.flatnonzero(room > 0)
    items = np.flatnonzero(loose)
    items = items[np.argsort(-lengths[items], kind="stable")]
    best_fit(lengths, items, open_, room[open_], len(used), out)
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Children replace the worst packing they beat; best first. Stops at the bound no packing can pass."""
    r = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // LENGTH)
    ranked = sorted(((fitness(lengths, p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])[:POPULATION]
    for k in range(CHILDREN):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = r.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[a][2], ranked[b][2], r)
        score = fitness(lengths, child)
        if score < ranked[-1][0] and all(score != x[0] for x in ranked):
            ranked[-1] = (score, POPULATION + k, child)
            ranked.sort(key=lambda x: x[:2])
    return [x[2] for x in ranked]


def _seed(block: int, island: int, epoch: int) -> int:
    return (int(block) * 1009 + int(island)) * 31 + epoch


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """First packings of an island, and its first epoch."""
    lengths = np.sort(pdf["length"].to_numpy())[::-1].astype(np.int64)
    block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
    r = np.random.default_rng(_seed(block, island, 0))
    first = [_decreasing(lengths, 0.15 * k * (island + 1) if k + island else 0.0, r) for k in range(POPULATION)]
    row = _row(block, island, lengths, evolve(lengths, first, _seed(block, island, 1)))
    return pd.DataFrame([row], columns=["block", "island", "lengths", "packings", "used"])


def _row(block, island, lengths, population):
    return block, island, lengths.astype(np.int32).tobytes(), [p.tobytes() for p in population], fitness(lengths, population[0])[0]


def _epoch(number: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for x in pdf.itertuples(index=False):
                lengths = np.frombuffer(x.lengths, np.int32).astype(np.int64)
                population = [np.frombuffer(p, np.int32) for p in [*x.packings, x.guest]]
                rows.append(_row(x.block, x.island, lengths, evolve(lengths, population, _seed(x.block, x.island, number))))
            yield pd.DataFrame(rows, columns=["block", "island", "lengths", "packings", "used"])

    return run


def _place(pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values(["length", "key"], ascending=[False, True]).reset_index(drop=True)
    packing = np.frombuffer(best["packing"].iloc[0], np.int32)
    pieces["sequence_id"] = pieces["block"].astype("int64") * (1 << 20) + packing
    pieces["offset"] = pieces.groupby(packing, sort=False)["length"].cumsum() - pieces["length"]
    return pieces.drop(columns=["block", "key"])


_STATE = "block int, island int, lengths binary, packings array<binary>, used int"


def pack(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``keep_ids`` the piece's ids as unsigned 32-bit numbers. A null or
    empty text is its end id alone. Rows with one doc_id are packed each for
    itself, a null doc_id stays null, other columns are not read, an empty
    table gives no rows.
    """
    extra = ["ids"] if keep_ids else []
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    texts = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), keep_ids), schema).withColumn("key", F.monotonically_increasing_id()), "pieces")
    small = pieces.filter(F.col("length") < LENGTH)
    blocks = max(1, -(-small.count() // BLOCK_ROWS))
    small = small.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    islands = small.select("block", "length", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"))
    # A stated number of partitions: merged by bytes, all groups would be one task's.
    state = islands.repartition(min(blocks * ISLANDS, GROUP_TASKS), "block", "island").groupBy("block", "island").applyInPandas(_settle, _STATE)
    ring = Window.partitionBy("block").orderBy("island")
    everywhere = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = state.repartition(min(blocks, GROUP_TASKS), "block")
    for number in range(2, EPOCHS + 1):
        elite = F.element_at("packings", 1)
        guest = F.coalesce(F.lag(elite).over(ring), F.last(elite).over(everywhere))
        state = state.withColumn("guest", guest).mapInPandas(_epoch(number), _STATE)
    best = state.groupBy("block").agg(F.min_by(F.element_at("packings", 1), F.struct("used", "island")).alias("packing"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *extra]
    out = schema + ", sequence_id long, offset long"
    placed = small.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_place, out)
    alone = pieces.filter(F.col("length") == LENGTH).select(*columns, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(alone)
