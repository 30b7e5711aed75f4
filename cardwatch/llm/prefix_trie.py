"""Prefix trie of conversations: every sequence of first turns that some share, with what sharing it saves.

A turn is 16 bytes, the head of the SHA-256 of its role and text as a big-endian
number, so a conversation is a key of fixed-width digits. Equal conversations
are one key. Keys are dealt into ranges of their order, and each range grows an
adaptive radix tree: a node holds its children in a layout for up to 4, 16, 48
or 256 of them, and bytes without a fork are one compressed path. Trie nodes
are the places of that tree whose byte depth is a whole number of turns.

A node that reaches over the end of a range is a prefix of the range's least or
greatest key. Such nodes are kept open, with what hangs on them, and one small
tree of the two keys of each range closes them. However many conversations
begin alike, they are dealt over many ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.session import remove, stage_at

#: Bytes of a turn.
WIDTH = 16
#: Keys and turns of a range, about.
RANGE_KEYS, RANGE_TURNS = 20_000, 400_000
#: A conversation starts like the one whose id is its own, rounded down to a multiple of this.
GROUP = 20

NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Sorted:
    """Children of up to ``room`` bytes, side by side in byte order."""

    def __init__(self, room: int) -> None:
        self.room, self.keys, self.kids = room, bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, child) -> bool:
        at = self.keys.find(byte)
        if at >= 0:
            self.kids[at] = child
            return True
        if len(self.kids) == self.room:
            return False
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.kids.insert(at, child)
        return True

    def items(self) -> list:
        return list(zip(self.keys, self.kids))


class _Indexed:
    """Children of up to 48 bytes: a byte's place in a short list, 0 for none."""

    room = 48

    def __init__(self) -> None:
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, child) -> bool:
        at = self.place[byte]
        if at:
            self.kids[at - 1] = child
            return True
        if len(self.kids) == self.room:
            return False
        self.kids.append(child)
        self.place[byte] = len(self.kids)
        return True

    def items(self) -> list:
        return [(byte, self.kids[at - 1]) for byte, at in enumerate(self.place) if at]


class _Full:
    """A place for every byte."""

    room = 256

    def __init__(self) -> None:
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child) -> bool:
        self.kids[byte] = child
        return True

    def items(self) -> list:
        return [(byte, kid) for byte, kid in enumerate(self.kids) if kid is not None]


_LARGER = {0: lambda: _Sorted(4), 4: lambda: _Sorted(16), 16: _Indexed, 48: _Full}


class _Node:
    """``path``: the bytes without a fork that lead here; ``value``: what the key that ends here holds."""

    __slots__ = ("path", "value", "layout")

    def __init__(self, path: bytes, value=None) -> None:
        self.path, self.value, self.layout = path, value, None

    def get(self, byte: int):
        return self.layout and self.layout.get(byte)

    def put(self, byte: int, child: _Node) -> None:
        if self.layout is None or not self.layout.put(byte, child):
            old = self.layout
            self.layout = _LARGER[old.room if old else 0]()
            for b, kid in old.items() if old else ():
                self.layout.put(b, kid)
            self.layout.put(byte, child)

    def children(self) -> list:
        return self.layout.items() if self.layout else []


class RadixTree:
    def __init__(self) -> None:
        self.root: _Node = _Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, above, depth = self.root, None, 0
        while True:
            path = node.path
            if not key.startswith(path, depth):
                same = next((i for i, (a, b) in enumerate(zip(path, key[depth : depth + len(path)])) if a != b), len(key) - depth)
                fork = _Node(path[:same])
                node.path = path[same + 1 :]
                fork.put(path[same], node)
                rest = key[depth + same :]
                if rest:
                    fork.put(rest[0], _Node(rest[1:], value))
                else:
                    fork.value = value
                above.put(key[depth - 1], fork)
                return
            depth += len(path)
            if depth == len(key):
                node.value = value
                return
            child = node.get(key[depth])
            if child is None:
                node.put(key[depth], _Node(key[depth + 1 :], value))
                return
            node, above, depth = child, node, depth + 1

    def turns(self, width: int) -> tuple[list, list[tuple[int, int, int]]]:
        """(values in key order, (turn, first, after last) of each place at a whole turn, children before parents).

        The keys through a place are those from first to last of the values.
        """
        values: list = []
        places: list[tuple[int, int, int]] = []
        stack: list[tuple[_Node, int, int]] = [(self.root, -1, -1)]
        while stack:
            node, begin, first = stack.pop()
            end = begin + 1 + len(node.path)
            if first < 0:
                stack.append((node, begin, len(values)))
                if node.value is not None:
                    values.append(node.value)
                stack.extend((kid, end, -1) for _, kid in reversed(node.children()))
            else:
                # Whole turns on the path, the fork's byte before it included.
                places.extend((at, first, len(values)) for at in range(end // width, begin // width, -1))
        return values, places


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class _Held:
    """What is known of a trie node: of its own, or of all that hangs on it."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "ends")

    def __init__(self, n=0, least=None, kids=0, leaves=0, saved=0, ends=None) -> None:
        self.n, self.least, self.kids, self.leaves, self.saved, self.ends = n, least, kids, leaves, saved, ends

    def add(self, other: _Held) -> None:
        self.n += other.n
        self.least = _least(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def hang(self, child: _Held) -> None:
        self.n += child.n
        self.least = _least(self.least, child.least)
        self.kids += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def close(self, words: int) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * words


def _paths(key: bytes) -> list[bytes]:
    """A name for each turn-aligned prefix of ``key``."""
    running = hashlib.sha256()
    out = [running.digest()]
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        out.append(running.copy().digest())
    return out


def summarise(keys: list[bytes], words: list[list[int]], held: list[dict[int, _Held]], whole: bool) -> tuple[list[tuple], list[tuple]]:
    """Rows of the trie nodes of different ``keys``, and the keys of nodes left open.

    ``words``: words of each turn of a key; ``held``: by turn, what hangs on a
    key's nodes. Unless ``whole``, the nodes on the least and greatest key stay
    open and are given back as (key, words, held). A row is (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends, path,
    parent's path); a parent left open has no conv_id.
    """
    if not keys:
        return [], []
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    order, places = tree.turns(WIDTH)
    size = len(order)
    names = {i: _paths(keys[i]) for i in (range(size) if whole else {order[0], order[-1]})}
    found: list[_Held] = []
    above: list[int] = [-1] * len(places)
    waiting: dict[int, list[int]] = {}
    sides: tuple[dict, dict] = ({}, {})
    for p, (depth, lo, hi) in enumerate(places):
        mine = _Held()
        for t in order[lo : hi if whole else lo + 1]:  # a key that ends here comes first
            if depth in held[t]:
                mine.add(held[t][depth])
        left_open = not whole and (lo == 0 or hi == size)
        for child in waiting.pop(depth + 1, ()):
            above[child] = p
            if not (left_open and _is_open(places[child], size)):
                mine.hang(found[child])
        if left_open:
            sides[lo != 0][depth] = mine
        else:
            mine.close(words[order[lo]][depth - 1] if depth else 0)
        found.append(mine)
        waiting.setdefault(depth, []).append(p)
    rows = []
    for p, (depth, lo, hi) in enumerate(places):
        if not whole and _is_open(places[p], size):
            continue
        x, up = found[p], above[p]
        open_above = not whole and _is_open(places[up], size)
        end = None if not open_above else order[0] if places[up][1] == 0 else order[-1]
        rows.append((
            x.least, depth, found[up].least if depth and not open_above else None, x.n, x.kids, x.leaves, x.saved, x.ends or NO_ENDS,
            names[order[lo]][depth] if whole else None, names[end][depth - 1] if open_above else None,
        ))
    edges = [] if whole else [(keys[t], words[t], side) for t, side in ((order[0], sides[0]), (order[-1], sides[1])) if side]
    return rows, edges


def _is_open(place: tuple[int, int, int], size: int) -> bool:
    return place[1] == 0 or place[2] == size


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_HELD = ["turn", "n", "least", "kids", "leaves", "saved"]
_ROWS = ", ".join(f"{c} long" for c in _NODE) + ", ends_sha256 string, path binary, parent_path binary"
_EDGES = "key binary, words array<long>, " + ", ".join(f"{c} array<long>" for c in _HELD) + ", ends array<string>"
_TYPES = [*[pa.int64()] * len(_NODE), pa.string(), pa.binary(), pa.binary()]
_EDGE_TYPES = [pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * len(_HELD), pa.list_(pa.string())]
_NAMES = [*_NODE, "ends_sha256", "path", "parent_path"]
_EDGE_NAMES = ["key", "words", *_HELD, "ends"]
#: Rows of an Arrow batch that is given back.
_OUT = 10_000


def _batches(rows: list[tuple], types: list, names: list[str], nulls_after: int = 0, nulls_before: int = 0, other=()) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), _OUT):
        part = rows[k : k + _OUT]
        own = [pa.array(c, t) for c, t in zip(zip(*part), types)]
        empty = [pa.nulls(len(part), t) for t in other[0]] if other else []
        arrays, labels = (own + empty, [*names, *other[1]]) if nulls_after else (empty + own, [*other[1], *names]) if nulls_before else (own, names)
        yield pa.RecordBatch.from_arrays(arrays, labels)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie nodes of a range of keys, and its two ends."""
    keys, words, held = [], [], []
    for batch in batches:
        for ids, counts, n, least, ends in zip(*[batch.column(c).to_pylist() for c in ("ids", "words", "n", "least", "ends")]):
            keys.append(b"".join(ids))
            words.append(counts)
            held.append({len(ids): _Held(n=n, least=least, ends=ends)})
    rows, edges = summarise(keys, words, held, whole=False)
    del keys, words, held
    yield from _batches(rows, _TYPES, _NAMES, nulls_after=1, other=(_EDGE_TYPES, _EDGE_NAMES))
    ends = [
        (key, counts, list(side), *[[getattr(h, f) for h in side.values()] for f in ("n", "least", "kids", "leaves", "saved")], [h.ends for h in side.values()])
        for key, counts, side in edges
    ]
    yield from _batches(ends, _EDGE_TYPES, _EDGE_NAMES, nulls_before=1, other=(_TYPES, _NAMES))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the ends of all ranges: two keys of each."""
    joined: dict[bytes, tuple[list, dict[int, _Held]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            _, own = joined.setdefault(row["key"], (row["words"], {}))
            for turn, n, least, kids, leaves, saved, ends in zip(*[row[c] for c in (*_HELD, "ends")]):
                own.setdefault(turn, _Held()).add(_Held(n, least, kids, leaves, saved, ends))
    rows, _ = summarise(list(joined), [w for w, _ in joined.values()], [h for _, h in joined.values()], whole=True)
    yield from _batches(rows, _TYPES, _NAMES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, least, digest of all) of the conversations of a key, which come in order; one running digest is held."""
    now, n, least, running = None, 0, None, None
    out: list[tuple] = []

    def finished() -> Iterator[pa.RecordBatch]:
        yield from _batches(out, [pa.int64(), pa.int64(), pa.string()], ["n", "least", "ends"])
        out.clear()

    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != now:
                if running is not None:
                    out.append((n, least, running.hexdigest()))
                now, n, least, running = key, 0, conv, hashlib.sha256()
            running.update(f",{conv}".encode() if n else str(conv).encode())
            n += 1
        if len(out) >= _OUT:
            yield from finished()
    if running is not None:
        out.append((n, least, running.hexdigest()))
    yield from finished()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, id, words) of ``conversations`` (conv_id, turn, role, text): turns by number, null first, equal ones by their id. Rows without conv_id are no turns."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "id")
    return turns.select("conv_id", F.row_number().over(order).alias("place"), "id", "words")


def heads_shared(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, ids, words) of conversations that each begin like the first of their group.

    ``turns`` as of ``numbered_turns``. The first h turns are those of
    conversation c - c % group (the remainder has the sign of c), all if it has
    fewer and none if it is absent, h being crc32(c in decimal) % 4; then come c's own after its first h.
    """
    conv = F.col("conv_id")
    h = F.crc32(conv.cast("string").cast("binary")) % 4
    item = F.struct("part", "place", "id", "words").alias("item")
    own = turns.filter(F.col("place") > h).withColumn("part", F.lit(1)).select("conv_id", item)
    all_ = turns.select("conv_id").distinct()
    heads = turns.filter((F.col("place") < 4) & (conv % group == 0)).withColumnRenamed("conv_id", "base")
    lent = all_.withColumn("base", conv - conv % group).join(heads, "base").filter(F.col("place") <= h).withColumn("part", F.lit(0)).select("conv_id", item)
    none = all_.select("conv_id", F.lit(None).cast(own.schema["item"].dataType).alias("item"))
    rebuilt = own.union(lent).union(none).groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rebuilt.select("conv_id", F.col("items.id").alias("ids"), F.col("items.words").alias("words"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie nodes of ``sequences`` (conv_id long, ids array of 16-byte turns, words array of their word counts).

    A node of depth d is a sequence of d first turns that some conversation
    has, from the root of depth 0. Returns conv_id (its smallest member; no two
    nodes of a depth share it), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes at or below it), saved_tokens
    (over all nodes at or below it, members less one times the words of the last
    turn) and ends_sha256 (of the ids, in order and with commas, of the
    conversations that end there).

    Conversations without turns end at the root. Equal conversations share all
    nodes. No conversations give no nodes. Other columns are not read. A row is
    one conversation, whose turns (16 bytes each, no texts) are held in one
    place. The ids of equal conversations pass through one task, because they
    have one digest; it holds one id at a time.
    """
    paths: list[str] = []

    def staged(df: DataFrame, label: str) -> DataFrame:
        table, path = stage_at(df, label)
        paths.append(path)
        return table

    spark = sequences.sparkSession
    given = staged(sequences.select("conv_id", "ids", F.col("words").cast("array<long>").alias("words")), "trie-sequences")
    key = F.unhex(F.sha2(F.array_join(F.transform("ids", F.hex), ""), 256))
    ends = (
        given.select(key.alias("key"), "conv_id")
        .repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_ends, "n long, least long, ends string")
    )
    keys = staged(given.join(ends, F.col("conv_id") == F.col("least")).select("ids", "words", "n", "least", "ends"), "trie-keys")
    count, turns = keys.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    ranges = max(count // RANGE_KEYS, turns // RANGE_TURNS) + 1
    grown = staged(keys.repartitionByRange(ranges, "ids").mapInArrow(_grown, f"{_ROWS}, {_EDGES}"), "trie-grown")
    edges = grown.filter("key is not null").select(*_EDGE_NAMES)
    closed = staged(edges.coalesce(1).mapInArrow(_closed, _ROWS), "trie-closed")
    rows = grown.filter("key is null").select(*_NAMES)
    inner = rows.filter("parent_path is null")
    parents = closed.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("above"))
    hung = rows.filter("parent_path is not null").join(parents, "parent_path").withColumn("parent_conv_id", F.col("above"))
    columns = [*_NODE, "ends_sha256"]
    out, _ = stage_at(inner.select(columns).union(hung.select(columns)).union(closed.select(columns)), "trie")
    for path in paths:
        remove(spark, path)
    return out
