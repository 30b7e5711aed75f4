"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents, as TF-IDF rows over hashed words, give a latent
space by a randomised SVD: every task multiplies its rows with one random
matrix and back, Spark sums the products by term, and only that sum (its size
fixed by the parameters) reaches the driver for the last small factorisation.
Windows of every document whose cosine with a part of a benchmark item is high
are then compared with the item word by word: the longest common subsequence
shows a copy, and a shorter one together with the item's last words, its
answer, a paraphrase. As both need most of the item's words, some of its rarest
are near every such window, and vectors and cosines are taken there only. Items shorter than a window are searched for by windows
of about their own size as well, and as an exact sequence of words; those in
scripts without spaces as an exact sequence of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cardwatch.llm.words import MARKS, Words, in_batches, slices
from cardwatch.session import stage

#: Hashed terms, dimensions of the latent space, and further random directions.
TERMS, RANK, MORE = 1 << 14, 48, 8
#: Words by which windows move on, such steps in a window, words in a passage.
STEP, STEPS = 8, 3
WINDOW = STEP * STEPS
#: Words between the parts of an item that are searched for.
PART_STEP = 12
#: Latent cosine of a candidate, and the cosine over the terms themselves from which it is compared word by word.
NEAR, NEAR_TERMS = 0.55, 0.3
#: Share of an item's words in common, in order: of a copy, and of a paraphrase that also has the answer.
COPY, PARAPHRASE = 0.7, 0.6
#: Last words of an item that are its answer, and the share of them that a paraphrase has in order.
ANSWER_WORDS, ANSWER = 6, 0.8
#: Items of fewer words are only found as exact sequences.
LEAST_WORDS = 8
#: Step of the four-step windows for items below ``WINDOW`` words, by the least number of their words.
SHORT_STEPS = {8: 2, 12: 3, 16: 4}
#: Bits of the map of the items' rare words.
_RARE_BITS = 20
#: Letters of scripts without spaces between words.
_UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
#: Words whose passages are summed up by term at once, and places of a term that are added one by one.
WORDS_BACK, RUN = 1 << 19, 64
#: Items that are sent to the tasks at once.
ITEMS_AT_ONCE = 10_000
_SEED = 20


def _terms(words: Words) -> np.ndarray:
    return (words.hashes() % np.uint64(TERMS)).astype(np.int32)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's terms as 16-bit numbers."""
    for batch in batches:
        for _, _, words in slices(batch.column("text"), apart=MARKS):
            offsets = pa.py_buffer((words.first * 2).astype(np.int32))
            raw = pa.py_buffer(_terms(words).astype("<u2"))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), words.texts, [None, offsets, raw])], ["terms"])


def _stored_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, first word of each text and the end) of runs of texts."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    terms = np.frombuffer(data, "<u2") if data is not None and data.size else np.zeros(0, "<u2")
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 17), side="right")) - 1)
        yield terms[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS, np.int64)
    for batch in batches:
        for terms, _ in _stored_slices(batch.column("terms")):
            total += np.bincount(terms, minlength=TERMS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "words"])


def _directions() -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((TERMS, RANK + MORE)).astype(np.float32)


def _run_sums(table: np.ndarray, at: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Sums of the rows ``at`` of ``table`` over runs that start at ``begin``.

    Runs are cut into parts of ``width`` places and added up place by place, the
    longer parts first, so that what is gathered at once stays small.
    """
    size = np.diff(np.append(begin, len(at)))
    parts = -(-size // width)
    first = np.cumsum(parts) - parts
    start = np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * width
    left = np.minimum(np.repeat(begin + size, parts) - start, width)
    by = np.argsort(-left, kind="stable")
    start, shorter = start[by], -left[by]
    sums = table[at[start]]
    row = np.empty_like(sums)
    for k in range(1, width):
        n = int(np.searchsorted(shorter, -k))  # parts of more than k places
        if not n:
            break
        np.take(table, at[start[:n] + k], axis=0, out=row[:n], mode="clip")
        sums[:n] += row[:n]
    row[by] = sums
    return row if len(row) == len(begin) else np.add.reduceat(row, first, axis=0)


def _products(weights: np.ndarray):
    """Of each task: its passages' rows times the random matrix, and back, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, squares = _directions() * weights[:, None], np.square(weights)
        total = np.zeros((TERMS, RANK + MORE))
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # terms, passages' sizes and rows

        def back() -> None:
            terms, sizes, seen = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            passage = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(terms, kind="stable")  # 16-bit numbers: by radix
            sorted_terms = terms[order]
            begin = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1]))
            total[sorted_terms[begin].astype(np.intp)] += _run_sums(seen, passage[order], begin, RUN)

        for batch in batches:
            for terms, first in _stored_slices(batch.column("terms")):
                if not len(terms):
                    continue
                n = np.diff(first)
                groups = -(-n // WINDOW)
                within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
                starts = np.repeat(first[:-1], groups) + within * WINDOW
                wide = terms.astype(np.intp)
                square = np.add.reduceat(squares[wide], starts)
                seen = _run_sums(weighted, wide, starts, WINDOW) / np.maximum(square, 1e-12)[:, None]
                waiting.append((terms, np.diff(np.append(starts, len(terms))), seen))
                if sum(len(t) for t, _, _ in waiting) >= WORDS_BACK:
                    back()
        if waiting:
            back()
        total *= weights[:, None]
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in total[at].T)], ["term", *_columns()])

    return run


def _columns() -> list[str]:
    return [f"y{k}" for k in range(RANK + MORE)]


@dataclass
class LatentSpace:
    """``table``: what a term adds to the latent vector of its window."""

    table: np.ndarray
    values: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(docs: DataFrame) -> LatentSpace:
        """The space of all passages of ``docs`` (text): every word of every row counts."""
        stored = stage(in_batches(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_stored, "terms binary"), "terms")
        counts = np.zeros(TERMS)
        for row in stored.mapInArrow(_counted, "term int, words long").groupBy("term").agg(F.sum("words").alias("words")).collect():
            counts[row["term"]] = row["words"]
        weights = np.log1p(max(counts.sum() / WINDOW, 1.0) / np.maximum(counts, 1)).astype(np.float32)
        parts = stored.mapInArrow(_products(weights), "term int, " + ", ".join(f"{c} double" for c in _columns()))
        summed = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in _columns()]).toPandas()
        y = np.zeros((TERMS, RANK + MORE))
        y[summed["term"].to_numpy(np.int64)] = summed[_columns()].to_numpy(np.float64)
        # One pass over a positive matrix S: with y = S times random r, S is near y (r'y)^-1 y'.
        random = _directions().astype(np.float64)
        small = random.T @ y
        small = (small + small.T) / 2
        shift = max(np.trace(small), 1e-9) * 1e-7
        factor = np.linalg.cholesky(small + shift * np.eye(len(small)) * 1.0) if len(summed) > len(small) else None
        if factor is None:  # fewer terms than dimensions: the terms are the space
            u, s, _ = np.linalg.svd(y, full_matrices=False)
        else:
            u, s, _ = np.linalg.svd(np.linalg.solve(factor, y.T).T, full_matrices=False)
        keep = s[:RANK] > s[0] * 1e-6
        table = (u[:, :RANK][:, keep] / s[:RANK][keep]) * weights[:, None]
        return LatentSpace(np.ascontiguousarray(table, dtype=np.float32), s, weights)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, an item's words being the bits of a number."""
    every = (1 << size) - 1
    v = every
    for w in words:
        m = masks.get(w)
        if m:
            x = v & m
            v = ((v + x) | (v - x)) & every
    return size - v.bit_count()


class Benchmark:
    """Items to search for: the latent vectors of their parts, and their words."""

    def __init__(self, rows: list[tuple[int, str]], space: LatentSpace):
        self.table, self.squares = space.table, np.square(space.weights)
        self.items, vectors, owner, held, sizes, words_of = [], [], [], [], [], []
        short: dict[int, tuple[list, list, list]] = {step: ([], [], []) for step in SHORT_STEPS.values()}
        self.exact: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        self.unspaced: list[tuple[int, bytes, re.Pattern]] = []
        for (item, _), (_, _, words) in zip(rows, slices(pa.array([t or "" for _, t in rows], pa.string()), apart=MARKS, most=1)):
            hashes = words.hashes()
            h = hashes.tolist()
            if not h:
                continue
            terms = (hashes % np.uint64(TERMS)).astype(np.int32)
            if len(h) >= LEAST_WORDS:
                places = sorted({*range(0, max(1, len(h) - WINDOW), PART_STEP), max(0, len(h) - WINDOW)})
                vectors += [space.table[terms[a : a + WINDOW]].sum(axis=0) for a in places]
                sizes += [np.sqrt(self.squares[terms[a : a + WINDOW]].sum()) for a in places]
                owner += [len(self.items)] * len(places)
                if len(h) < WINDOW:
                    mine = short[SHORT_STEPS[max(n for n in SHORT_STEPS if n <= len(h))]]
                    for to, x in zip(mine, (vectors[-1], sizes[-1], len(self.items))):
                        to.append(x)
            if len(h) < WINDOW:
                rarest = int(np.argmax(space.weights[terms]))
                self.exact.setdefault(h[rarest], []).append((len(self.items), rarest, hashes))
            self._unspaced(words)
            words_of.append(hashes)
            bits = np.zeros(TERMS, bool)
            bits[terms] = True
            held.append(np.packbits(bits))
            self.items.append((item, len(h), _masks(h), min(ANSWER_WORDS, len(h)), _masks(h[-ANSWER_WORDS:])))
        self.short = {
            step: (_unit(np.array(v, np.float32).reshape(len(v), space.table.shape[1])), np.array(z, np.float32), np.array(o, np.int64))
            for step, (v, z, o) in short.items() if o
        }
        self._note_rare(words_of, space.weights)
        self.anchors = np.zeros(TERMS, bool)
        self.anchors[[x % TERMS for x in self.exact]] = True
        self.vectors = _unit(np.array(vectors, np.float32).reshape(len(vectors), space.table.shape[1]))
        self.owner, self.sizes = np.array(owner, np.int64), np.array(sizes, np.float32)
        self.held = np.array(held, np.uint8).reshape(len(held), TERMS // 8)

    def _note_rare(self, words_of: list[np.ndarray], weights: np.ndarray) -> None:
        """Rare words of the items, and how many of them a leak of an item has at least.

        A leak lacks a share of 1 - ``PARAPHRASE`` of an item's words at most,
        so of any so many words and ``need`` more it has ``need``, at places of
        its own.
        """
        held: dict[int, list[int]] = {}
        need, sizes = [], []
        for item, hashes in enumerate(words_of):
            size = len(hashes)
            lacks = size - int(np.ceil(PARAPHRASE * size - 1e-9))
            need.append(max(1, size // 10))
            sizes.append(size)
            rarest = np.argsort(-weights[(hashes % np.uint64(TERMS)).astype(np.int64)], kind="stable")[: lacks + need[-1]]
            for h in {int(x) for x in hashes[rarest]}:
                held.setdefault(h, []).append(item)
        self.need, self.size_of = np.array(need, np.int64), np.array(sizes, np.int64)
        self.rare = np.array(sorted(held), np.uint64)
        self.rare_items = np.array([i for h in sorted(held) for i in held[h]], np.int64)
        self.rare_first = np.cumsum([0, *(len(held[h]) for h in sorted(held))])
        self.rare_map = np.zeros(1 << _RARE_BITS, bool)
        self.rare_map[(self.rare & np.uint64((1 << _RARE_BITS) - 1)).astype(np.int64)] = True

    def search(self, words: Words) -> list[list[tuple[int, float, float, bool]]]:
        """Leaks of each text: (item, cosine, share of the item in common, whether it is a copy)."""
        found: list[list[tuple[int, float, float, bool]]] = [[] for _ in range(words.texts)]
        if not len(words.start) or not self.items:
            return found
        hashes = words.hashes()
        terms = (hashes % np.uint64(TERMS)).astype(np.int32)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        rare = self._rare_places(hashes)
        self._windows(words, hashes, terms, rare, STEP, STEPS, self.vectors, self.sizes, self.owner, best)
        for step, (vectors, sizes, owner) in self.short.items():
            self._windows(words, hashes, terms, rare, step, 4, vectors, sizes, owner, best)
        self._sequences(words, hashes, terms, best)
        for (doc, item), (share, cosine, copy) in sorted(best.items()):
            found[doc].append((self.items[item][0], cosine, share, copy))
        return found

    def _rare_places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) where a rare word of an item stands, by item and place."""
        at = np.flatnonzero(self.rare_map[(hashes & np.uint64((1 << _RARE_BITS) - 1)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.rare, hashes[at]), len(self.rare) - 1)
        known = self.rare[slot] == hashes[at]
        at, slot = at[known], slot[known]
        n = self.rare_first[slot + 1] - self.rare_first[slot]
        item = self.rare_items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.rare_first[slot], n)]
        place = np.repeat(at, n)
        order = np.lexsort((place, item))
        return place[order], item[order]

    def _candidates(self, words: Words, rare: tuple[np.ndarray, np.ndarray], step: int, count: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, item) of the windows that have enough of an item's rare words around them."""
        place, item = rare
        asked = np.zeros(len(self.items), bool)
        asked[owner] = True
        first = np.flatnonzero(asked[item])
        last = first + self.need[item[first]] - 1
        first, last = first[last < len(place)], last[last < len(place)]
        size, doc = self.size_of[item[first]], words.doc[place[first]]
        # A window at a is compared with the words from a - size to a + step * count + size.
        low, high = place[last] - step * count - size + 1, place[first] + size
        near = (item[last] == item[first]) & (words.doc[place[last]] == doc) & (low <= high)
        first, doc, low, high = first[near], doc[near], low[near], high[near]
        begin, most = words.first[doc], np.maximum(-(-words.counts()[doc] // step) - count, 0)
        low, high = np.maximum(-(-(low - begin) // step), 0), np.minimum((high - begin) // step, most)
        n = np.maximum(high - low + 1, 0)
        start = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)) * step
        both = np.unique(start * len(self.items) + np.repeat(item[first], n))
        start, item = np.divmod(both, len(self.items))
        return words.doc[start], start, item

    def _windows(self, words: Words, hashes: np.ndarray, terms: np.ndarray, rare: tuple[np.ndarray, np.ndarray], step: int, count: int, parts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, best: dict) -> None:
        """Leaks that windows of ``count`` steps of ``step`` words show."""
        if not len(owner):
            return
        doc, start, item = self._candidates(words, rare, step, count, owner)
        if not len(start):
            return
        end = words.first[doc + 1]
        windows, which = np.unique(start, return_inverse=True)
        ends = words.first[words.doc[windows] + 1]
        vectors = np.zeros((len(windows), self.table.shape[1]), np.float32)
        for k in range(step * count):
            inside = windows + k < ends
            vectors[inside] += self.table[terms[windows[inside] + k]]
        vectors = _unit(vectors)
        low, high = np.searchsorted(owner, item, "left"), np.searchsorted(owner, item, "right")
        n = high - low
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pair = np.repeat(np.arange(len(start)), n)
        cosines = np.einsum("ij,ij->i", vectors[which[pair]], parts[part])
        near = np.flatnonzero(cosines >= NEAR)
        pair, part, cosines = pair[near], part[near], cosines[near]
        keep = self._share_terms(terms, start[pair], end[pair], item[pair], sizes[part], step * count)
        for p, cosine in zip(pair[keep].tolist(), cosines[keep].tolist()):
            d, i, a = int(doc[p]), int(item[p]), int(start[p])
            _, size, masks, answer_size, answer = self.items[i]
            lo, hi = max(int(words.first[d]), a - size), min(int(words.first[d + 1]), a + step * count + size)
            region = hashes[lo:hi].tolist()
            share = common_words(masks, size, region) / size
            copy = share >= COPY
            if not copy and not (share >= PARAPHRASE and common_words(answer, answer_size, region) >= ANSWER * answer_size):
                continue
            now = (share, float(cosine), copy)
            if now > best.get((d, i), (0.0, 0.0, False)):
                best[d, i] = now

    def _unspaced(self, words: Words) -> None:
        """Notes the last item by its characters, if it has letters of a script without spaces."""
        runs = [bytes(words.data[a:b]).decode("utf-8", "replace") for a, b in zip(words.start, words.end)]
        text = " ".join(runs)
        if re.search(_UNSPACED, text):
            edge = ["" if re.match(_UNSPACED, text[k]) or not text[k].isalnum() else x for k, x in ((0, "(?:^|(?<= ))"), (-1, "(?= |$)"))]
            self.unspaced.append((len(self.items), max(runs, key=len).encode(), re.compile(edge[0] + re.escape(text) + edge[1])))

    def _sequences(self, words: Words, hashes: np.ndarray, terms: np.ndarray, best: dict) -> None:
        """Leaks that are exact sequences of an item's words, or of its characters."""
        for k in np.flatnonzero(self.anchors[terms]):
            doc = int(words.doc[k])
            for item, place, whole in self.exact.get(int(hashes[k]), ()):
                a = int(k) - place
                if a >= words.first[doc] and a + len(whole) <= words.first[doc + 1] and (doc, item) not in best and np.array_equal(hashes[a : a + len(whole)], whole):
                    best[doc, item] = (1.0, 1.0, True)
        if not self.unspaced or not (words.data >= 0xE0).any():
            return
        raw, texts = words.data.tobytes(), {}
        for item, longest, pattern in self.unspaced:
            at = raw.find(longest)
            while at >= 0:
                doc = int(np.searchsorted(words.offsets, at, side="right")) - 1
                if doc not in texts:
                    a, b = words.first[doc], words.first[doc + 1]
                    texts[doc] = " ".join(raw[x:y].decode("utf-8", "replace") for x, y in zip(words.start[a:b], words.end[a:b]))
                if pattern.search(texts[doc]):
                    best[doc, item] = (1.0, 1.0, True)
                at = raw.find(longest, int(words.offsets[doc + 1]))

    def _share_terms(self, terms: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
        """Of candidate windows: whether they hold enough of the item's terms, by weight."""
        both, own = np.zeros(len(start), np.float32), np.zeros(len(start), np.float32)
        for k in range(window):
            inside = start + k < end
            t = terms[np.minimum(start + k, len(terms) - 1)]
            weight = self.squares[t] * inside
            own += weight
            both += weight * (self.held[item, t >> 3] >> (7 - (t & 7)) & 1)
        return both >= NEAR_TERMS * np.sqrt(own) * sizes


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def prepare(docs: DataFrame, benchmark: DataFrame) -> list[Benchmark]:
    """The benchmark (item_id, text) in the space of ``docs``, in blocks of bounded size; rows without an id or text are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct().orderBy("item_id", "text").collect()
    space = LatentSpace.fit(docs)
    return [Benchmark([tuple(r) for r in rows[a : a + ITEMS_AT_ONCE]], space) for a in range(0, len(rows), ITEMS_AT_ONCE)]


_WORDS_AT_ONCE = 1 << 18


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and item found in it: doc_id, item_id, cosine, share, copied.

    ``share`` is the part of the item's words that the document has in order;
    ``copied`` tells a copy from a paraphrase. Null and empty texts hold no
    item, items of under ``LEAST_WORDS`` words are only found word by word
    (one of a single common word is in every text with it), repeated rows give repeated results, null ids stay null, other columns are not read,
    empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in prepare(docs, benchmark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in slices(batch.column("text"), apart=MARKS, most=_WORDS_AT_ONCE):
                found = [sum(x, []) for x in zip(*(b.value.search(words) for b in shared))] or [[]] * (j - i)
                row = [i + k for k, x in enumerate(found) for _ in x]
                flat = [x for part in found for x in part]
                columns = [pa.array([x[c] for x in flat], kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], ["doc_id", "item_id", "cosine", "share", "copied"])

    return texts.mapInArrow(run, "doc_id long, item_id long, cosine double, share double, copied boolean")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any others) that hold no item of the benchmark, as they are."""
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in prepare(docs, benchmark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(len(batch), bool)
            for i, j, words in slices(batch.column("text"), apart=MARKS, most=_WORDS_AT_ONCE):
                for block in shared:
                    clean[i:j] &= [not x for x in block.value.search(words)]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
