"""Near-duplicate documents by 64-bit similarity hashes, compared bit-sliced.

A fingerprint bit is the majority of that bit over the hashes of a text's
shingles. Equal fingerprints form one node. Two that differ in ``RADIUS`` bits
agree in one of ``RADIUS`` + 1 parts of the bits, so nodes are dealt into
buckets by the value of each part. A bucket with more than ``BUCKET_ROWS``
nodes is dealt again by parts of the bits it does not share yet, which loses
no pair and ends, for a bucket that shares all but a few bits is small.

In a bucket nodes are held as bit planes: word j of plane i has bit i of nodes
64 j to 64 j + 63. One exclusive-or compares a node with 64 others in one bit,
a carry-save counter of three bit vectors adds up their distances, and a block
of 64 is abandoned once all of it is beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.components import components
from cardwatch.llm.words import Words, in_batches, slices
from cardwatch.session import remove, stage_at

WIDTH = 3
BITS = 64
#: Linked fingerprints differ in so many bits at most. The counters below hold up to 2.
RADIUS = 2
SEED = 42
#: Nodes of a bucket that are compared with one another: 1 MB of planes and ids.
BUCKET_ROWS = 1 << 14
#: Comparisons of a node with a block of 64 that are under way at once.
BLOCKS_AT_ONCE = 1 << 15
#: Hashes whose bits are counted at once.
_HASHES_AT_ONCE = 1 << 17
#: Bits after which abandoned blocks are sorted out.
_SIFT = 4

_ALL = np.uint64((1 << BITS) - 1)


def _shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the runs of ``WIDTH`` words joined by spaces; a shorter text with words is one run."""
    size = words.end - words.start
    ends = np.cumsum(size + 1)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - 1, size + 1)
    joined = np.full(len(at), 0x20, np.uint8)
    letters = at < np.repeat(size, size + 1)
    joined[letters] = words.data[(at + np.repeat(words.start, size + 1))[letters]]
    data = memoryview(joined)
    first = ends - size - 1
    count = words.counts()
    runs = np.maximum(count - WIDTH + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(words.texts), runs)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + words.first[:-1][doc]
    last = np.minimum(begin + WIDTH, words.first[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(first[begin].tolist(), (ends[last] - 1).tolist())
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(doc)), doc


def _majorities(hashes: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    total, set_ = np.bincount(doc, minlength=texts), np.zeros((texts, BITS), np.int64)
    for k in range(0, len(hashes), _HASHES_AT_ONCE):
        part, own = hashes[k : k + _HASHES_AT_ONCE], doc[k : k + _HASHES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        set_[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * set_ > total[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column("text")):
            prints = _majorities(*_shingle_hashes(words), words.texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def _planes(prints: np.ndarray) -> np.ndarray:
    """(bit, block): bit planes of nodes in blocks of 64."""
    padded = np.zeros(-(-len(prints) // BITS) * BITS, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _within(prints: np.ndarray, planes: np.ndarray, node: np.ndarray, block: np.ndarray, beyond: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparisons of ``node`` with ``block`` that are left after ``bits``, and the lanes beyond the radius. Lanes set in ``beyond`` are not asked for."""
    ones, twos = np.zeros_like(beyond), np.zeros_like(beyond)
    for k, bit in enumerate(bits):
        own = np.uint64(0) - ((prints[node] >> np.uint64(bit)) & np.uint64(1))
        add = planes[bit][block] ^ own
        carry = ones & add
        ones ^= add
        beyond |= twos & carry | twos & ones  # the third difference
        twos |= carry
        if k % _SIFT == _SIFT - 1:
            left = np.flatnonzero(beyond != _ALL)
            if not len(left):
                return node[:0], block[:0], beyond[:0]
            if 4 * len(left) < 3 * len(node):
                node, block, beyond, ones, twos = node[left], block[left], beyond[left], ones[left], twos[left]
    return node, block, beyond


def _least_reached(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that links reach within a part of buckets."""
    label = np.arange(size)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def bucket_links(prints: np.ndarray, bucket: np.ndarray, bits: list[int]) -> np.ndarray:
    """For each node the least place among those that links within its bucket reach.

    Rows of a bucket are side by side; ``bits`` are those in which they can differ.
    """
    planes, size = _planes(prints), len(prints)
    begin = np.searchsorted(bucket, bucket, side="left")
    # A node is compared with the nodes before it in its bucket.
    first, count = begin // BITS, -(-np.arange(size) // BITS) - begin // BITS
    count[np.arange(size) == begin] = 0

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(count)
        i = 0
        while i < size:
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + BLOCKS_AT_ONCE, side="right")))
            node = np.repeat(np.arange(i, j), count[i:j])
            block = np.arange(len(node)) - np.repeat(ends[i:j] - count[i:j] - done, count[i:j]) + first[node]
            low, high = begin[node] - block * BITS, np.minimum(node - block * BITS, BITS)
            beyond = np.where(low > 0, (np.uint64(1) << np.maximum(low, 0).astype(np.uint64)) - np.uint64(1), np.uint64(0))
            beyond |= np.where(high < BITS, _ALL << np.minimum(high, BITS - 1).astype(np.uint64), np.uint64(0))
            node, block, beyond = _within(prints, planes, node, block, beyond, bits)
            near = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(near)
            yield node[at], block[at] * BITS + lane
            i = j

    return _least_reached(size, pairs())


def _links_of(prints: np.ndarray, nodes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows ordered by (mask, shared bits): a row to the least one that it reaches."""
    a, b = [], []
    for own in np.unique(mask):
        rows = np.flatnonzero(mask == own)
        shared = np.uint64(int(own) & int(_ALL))
        bits = [i for i in range(BITS) if not int(shared) >> i & 1]
        bucket = prints[rows] & shared
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        to = bucket_links(prints[rows], bucket, bits)
        moved = np.flatnonzero(to != np.arange(len(to)))
        a.append(nodes[rows[moved]])
        b.append(nodes[rows[to[moved]]])
    return np.concatenate(a), np.concatenate(b)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, shared, print, node) come ordered by bucket; whole buckets are compared, a part of them at a time."""
    held = np.zeros((4, 0), np.int64)

    def out(rows: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of(rows[2].view(np.uint64), rows[3], rows[0])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "shared", "print", "node")])], axis=1)
        if held.shape[1] >= 2 * BUCKET_ROWS:
            last = (held[0] == held[0, -1]) & (held[1] == held[1, -1])
            whole = int(np.argmax(last))  # the last bucket may go on
            if whole:
                yield out(np.ascontiguousarray(held[:, :whole]))
                held = held[:, whole:]
    if held.shape[1]:
        yield out(np.ascontiguousarray(held))


def _parts(mask: int) -> list[int]:
    """``mask`` and one of ``RADIUS`` + 1 nearly equal parts of the other bits, as signed numbers."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    out = [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each of ``rows`` (mask, print, node), once for each part that its mask leaves."""
    choice = F.create_map(*[x for m in masks for x in (F.lit(m).cast("long"), F.array(*[F.lit(p).cast("long") for p in _parts(m & ((1 << BITS) - 1))]))])
    return rows.select(F.explode(F.element_at(choice, F.col("mask"))).alias("mask"), "print", "node").withColumn("shared", F.col("print").bitwiseAND(F.col("mask")))


def _buckets(nodes: DataFrame, staged) -> DataFrame:
    """(mask, shared, print, node) of buckets of two nodes up to ``BUCKET_ROWS``."""
    rows, masks, out = nodes.withColumn("mask", F.lit(0).cast("long")), [0], None
    while True:
        rows = _dealt(rows, masks)
        # Two masks can have a part in common.
        rows = staged(rows if out is None else rows.distinct(), "prints-dealt")
        masks = sorted({p for m in masks for p in _parts(m & ((1 << BITS) - 1))})
        size = rows.groupBy("mask", "shared").agg(F.count("*").alias("rows")).filter("rows > 1")
        size = staged(size, "prints-buckets")
        few = rows.join(size.filter(F.col("rows") <= BUCKET_ROWS).select("mask", "shared"), ["mask", "shared"])
        out = few if out is None else out.union(few)
        large = size.filter(F.col("rows") > BUCKET_ROWS).select("mask", "shared")
        if large.isEmpty():
            return out
        rows = rows.join(large, ["mask", "shared"]).select("mask", "print", "node")


def _own_links(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """A document with several texts joins the nodes of all of them."""
    several = found.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("doc_id is not null and x != y").select("doc_id")
    mine = found.join(several, "doc_id").join(nodes.select("print", "node"), "print")
    return mine.filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, fingerprint, component_id.

    Words are runs outside ASCII white space with A-Z in lower case. The hashes
    are XXH64 (seed 42) of the runs of three words, repeats included, joined by
    a space; a text of fewer words is one run. A bit of the fingerprint is set
    if it is in over half of them. Fingerprints that differ in two bits at most
    are linked; ``component_id`` is the smallest doc_id that links reach.

    A text that is null, empty or white space has fingerprint zero and is linked
    like any other. Rows with one doc_id are one document with several texts. A
    null doc_id takes part in no link and keeps a null component. Other columns
    are not read. An empty table gives no rows.
    """
    paths: list[str] = []

    def staged(df: DataFrame, label: str) -> DataFrame:
        table, path = stage_at(df, label)
        paths.append(path)
        return table

    docs = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage_at(docs.mapInArrow(_fingerprints, "doc_id long, print long"), "prints")[0]
    nodes = staged(found.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "prints-nodes")
    buckets = _buckets(nodes.select("print", "node"), staged)
    compared = buckets.repartition("mask", "shared").sortWithinPartitions("mask", "shared", "print").mapInArrow(_compared, "a long, b long")
    links = compared.union(_own_links(found, nodes))
    names = nodes.join(components(links), "node", "left").select("print", F.coalesce("component", "node").alias("component"), "node", "copies")
    names = stage_at(names.filter("copies > 1 or component != node").select("print", "component"), "prints-named")[0]
    for path in paths:
        remove(docs.sparkSession, path)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.join(names, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
