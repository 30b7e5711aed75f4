"""Per-event window counts on a stream, in checkpointed state.

Each rule is one stateful operator; two are chained (card, then IP). Keys are
hashed to buckets, and a bucket holds its ticks (key, millisecond, count) by
blocks of time, each block one small Arrow table in a map. A micro-batch reads
the blocks that its rows can count in and writes those its rows are in; a call
of the operator counts all rows of a bucket at once. The state lives in the
query's checkpoint: a restart or a moved partition finds it again.

Spark hands rows to such an operator one by one, which costs more than counting
them. So rows travel packed: before the first rule a task packs its rows into
one Arrow table per bucket, a rule reads and gives such tables, by buckets of
the next rule, and after the last one they are rows again.

Rows are counted in arrival order: micro-batch by micro-batch, and by
(ts_ms, seq) inside one. A row drops the ticks of its key that are older than
its window, for good, and a late row also counts the newer ticks it finds. A
block that is not read keeps dropped ticks until it is; the round in which a
tick came tells them apart then. Old blocks go whole and unread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardwatch.operators.velocity import CARD, IP, WindowRule

# Event time after which a block of ticks is forgotten, counted back from the
# newest event of its bucket (or from now, if an event claims to be from the
# future). Fixed value: ten minutes.
RETENTION_MS = 600_000

# Nothing must have come into the block for so long by the clock either. Rows
# that are late within this time are counted alike, however keys share buckets.
IDLE_MS = 600_000

# Buckets of keys per rule. Several per core of the cluster; fixed for the life
# of a checkpoint, because the state is stored per bucket.
STATE_BUCKETS = 256

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Columns that only pass through cross as JSON, times with all their digits.
_CARRIED = {
    "ignoreNullFields": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Rows and bytes that a task packs at once, and that a packed table holds at most.
PACK_ROWS, PACK_BYTES = 1 << 17, 16 << 20

_PACKED = T.StructType([T.StructField("now", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("_bucket", T.IntegerType())])
_BLOCK = T.StructType([T.StructField("block", T.LongType())])
_TICKS = T.StructType([T.StructField("ticks", T.BinaryType())])
_CAME = T.StructType([T.StructField("came", T.LongType()), T.StructField("round", T.LongType())])


class Ticks:
    """``key`` is an Arrow string array; ``ms``, ``n`` and ``round`` are numpy arrays beside it."""

    __slots__ = ("key", "ms", "n", "round")

    def __init__(self, key=None, ms=None, n=None, round_=None):
        zero = np.zeros(0, "i8")
        self.key = pa.array([], pa.string()) if key is None else key
        self.ms, self.n, self.round = (zero if x is None else x for x in (ms, n, round_))

    def __len__(self) -> int:
        return len(self.ms)

    def take(self, which: np.ndarray) -> Ticks:
        return Ticks(self.key.take(pa.array(which)), self.ms[which], self.n[which], self.round[which])

    @staticmethod
    def join(parts: Sequence[Ticks]) -> Ticks:
        if not parts:
            return Ticks()
        return Ticks(pa.concat_arrays([p.key for p in parts]), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("ms", "n", "round")))

    def pack(self) -> bytes:
        table = pa.table({"key": self.key.dictionary_encode(), "ms": self.ms, "n": self.n, "round": self.round})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(data: bytes) -> Ticks:
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        key = table["key"].cast(pa.string()).combine_chunks()
        key = key if isinstance(key, pa.Array) else key.chunk(0) if key.num_chunks else pa.array([], pa.string())
        return Ticks(key, *(table[c].to_numpy() for c in ("ms", "n", "round")))


def _codes(*keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = pa.concat_arrays(list(keys)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype("i8"), coded.dictionary


def _not_dropped(code: np.ndarray, ms: np.ndarray, round_: np.ndarray, window_ms: int) -> np.ndarray:
    """Ticks that no row of their key has dropped: none came in their round or later that is over a window newer."""
    if not len(ms):
        return np.zeros(0, bool)
    order = np.lexsort((-round_, code))
    moments, rank = np.unique(ms, return_inverse=True)
    c, r, base = code[order], round_[order], code[order] * (len(moments) + 1)
    newest = np.maximum.accumulate(base + rank[order]) - base
    begins = np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]
    last = np.r_[np.flatnonzero(begins)[1:], len(c)] - 1  # of each round of a key
    alive = np.empty(len(ms), bool)
    alive[order] = ms[order] >= moments[newest[last][np.cumsum(begins) - 1]] - window_ms
    return alive


def count_arrivals(held: Ticks, keys: pa.Array, times: np.ndarray, window_ms: int, now: int) -> tuple[np.ndarray, Ticks]:
    """Count one micro-batch of a bucket, its round ``now``.

    ``held`` is the state that was read. ``keys`` and ``times`` are the rows,
    times ascending within a key. Returns the count per row and the new state.
    """
    size = len(held)
    codes, names = _codes(held.key, keys)
    alive = _not_dropped(codes[:size], held.ms, held.round, window_ms)
    codes = np.concatenate((codes[:size][alive], codes[size:]))
    weight = np.concatenate((held.n[alive], np.ones(len(times), dtype="i8")))
    ms = np.concatenate((held.ms[alive], times))
    rounds = np.concatenate((held.round[alive], np.full(len(times), now)))
    size = int(alive.sum())
    moments, rank = np.unique(ms, return_inverse=True)
    stride = len(moments) + 1
    place = codes * stride + rank  # orders ticks by (key, time)

    order = np.argsort(place[size:], kind="stable")
    rows = place[size:][order]
    code, when = codes[size:][order], times[order]
    floor = code * stride + np.searchsorted(moments, when - window_ms, side="left")
    own = np.arange(1, len(rows) + 1) - np.searchsorted(rows, floor, side="left")

    shelf = np.argsort(place[:size], kind="stable")
    ticks = place[:size][shelf]
    upto = np.concatenate(([0], np.cumsum(weight[:size][shelf])))
    earlier = upto[np.searchsorted(ticks, (code + 1) * stride)] - upto[np.searchsorted(ticks, floor)]
    counts = np.empty(len(rows), dtype="i8")
    counts[order] = own + earlier

    spots, where = np.unique(place, return_inverse=True)
    n = np.zeros(len(spots), "i8")
    np.add.at(n, where, weight)
    newest = np.zeros(len(spots), "i8")
    np.maximum.at(newest, where, rounds)
    owner, at = spots // stride, moments[spots % stride]
    cut = np.full(len(names), np.iinfo("i8").min)
    np.maximum.at(cut, code, when - window_ms)
    live = at >= cut[owner]
    return counts, Ticks(names.take(pa.array(owner[live])), at[live], n[live], newest[live])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], joined.type)


def _packed(rows: pa.Table, by: str | None) -> Iterator[tuple[int | None, bytes]]:
    """``rows`` as tables of one value of ``by`` and a bounded size each, without that column if it is given."""
    if not len(rows):
        return
    groups = [(None, 0, len(rows))]
    if by is not None:
        rows = rows.take(pc.sort_indices(rows[by]))
        value = rows[by].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        groups = [(int(value[a]), a, b) for a, b in zip(cuts, cuts[1:])]
        rows = rows.drop_columns([by])
    rows = rows.combine_chunks()
    step = max(1, min(PACK_ROWS, PACK_BYTES * len(rows) // max(1, rows.nbytes)))
    for value, a, b in groups:
        for k in range(a, b, step):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows.slice(k, min(step, b - k)))
            yield value, sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def _pack_rows(names: Sequence[str], by: str):
    """Rows of a task (first the clock, then ``names``) as packed tables by bucket."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        now, got = rows.column(0)[0].as_py(), list(_packed(rows.remove_column(0).rename_columns(list(names)), by))
        columns = [pa.array([now] * len(got), pa.int64()), pa.array([d for _, d in got], pa.binary()), pa.array([b for b, _ in got], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, _PACKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PACK_ROWS or size >= PACK_BYTES:
                yield from flush(held)
                held, n, size = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("rows").to_pylist():
            yield from _unpacked(data).to_batches()


class WindowCounter(StatefulProcessor):
    """Adds the window count to every row of a bucket. Rows come and go packed, on their way to the buckets in ``then``."""

    def __init__(
        self,
        rule: WindowRule,
        columns: Sequence[str],
        retention_ms: int | None,
        skip: str | None = None,
        idle_ms: int = IDLE_MS,
        then: str | None = None,
    ):
        self.rule = rule
        self.columns = list(columns)
        self.retention_ms = retention_ms
        self.skip = skip
        self.idle_ms = idle_ms
        self.then = then

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", _BLOCK, _TICKS)
        # When, and in which round of the bucket, rows last came into a block: known without reading its ticks.
        self.came = handle.getMapState("came", _BLOCK, _CAME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # By place: a column that is one value for the whole micro-batch comes without its name.
        tables = [(int(now), _unpacked(data)) for frame in rows for now, data in zip(frame.iloc[:, 0], frame.iloc[:, 1])]
        # A bucket's tables together are at most one micro-batch, whose size the source caps.
        now, batch = tables[0][0], pa.concat_tables([t for _, t in tables])
        del tables
        batch = batch.take(pc.sort_indices(batch, [("ts_ms", "ascending"), ("seq", "ascending")])).combine_chunks()
        counts = np.zeros(len(batch), "i8")
        counted = np.arange(len(batch)) if self.skip is None else np.flatnonzero(batch[self.skip].is_null().to_numpy())
        if len(counted):
            mine = batch.select([self.rule.key, "ts_ms"]).take(pa.array(counted))
            counts[counted] = self._counted(_whole(mine[self.rule.key].cast(pa.string())), mine["ts_ms"].to_numpy().astype("i8"), now)
        batch = batch.select(self.columns).append_column(self.rule.out, pa.array(counts))
        for bucket, data in _packed(batch, self.then):
            yield pd.DataFrame({"now": [now], "rows": [data], "_bucket": pd.array([bucket], "Int32")})

    def _count(self, batch: pd.DataFrame, now: int) -> np.ndarray:
        return self._counted(pa.array(batch[self.rule.key], pa.string()), batch["ts_ms"].to_numpy("i8"), now)

    def _counted(self, keys: pa.Array, times: np.ndarray, now: int) -> np.ndarray:
        size = self.rule.window_ms
        came = {block[0]: tuple(at) for block, at in self.came.iterator()}
        number = 1 + max((r for _, r in came.values()), default=0)
        first = (int(times[0]) - self.rule.window_ms) // size
        read = [Ticks.unpack(bytes(self.blocks.getValue((b,))[0])) for b in sorted(came) if b >= first]
        counts, ticks = count_arrivals(Ticks.join(read), keys, times, self.rule.window_ms, number)
        block = ticks.ms // size
        for b in np.unique(times // size).tolist():
            self.blocks.updateValue((b,), (ticks.take(np.flatnonzero(block == b)).pack(),))
            came[b] = now, number
            self.came.updateValue((b,), came[b])
        if self.retention_ms is not None:
            newest = max(int(times[-1]), max(came) * size)
            horizon = min(newest, now) - max(self.retention_ms, self.rule.window_ms)
            for b, (at, _) in came.items():
                if (b + 1) * size <= horizon and at <= now - self.idle_ms:
                    self.blocks.removeKey((b,))
                    self.came.removeKey((b,))
        return counts

    def close(self) -> None:
        pass


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


def stream_velocity(
    tx: DataFrame,
    rules: Sequence[WindowRule] = (CARD, IP),
    retention_ms: int | None = RETENTION_MS,
    buckets: int = STATE_BUCKETS,
    skip: str | None = None,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Add one window count per rule to a stream of transactions.

    ``seq`` must be a plain column (a number or a string). Needs the RocksDB
    state store (``use_rocksdb``). No watermark comes before it, so late rows
    are scored like any other. ``retention_ms`` None keeps all blocks forever.
    Rows whose ``skip`` column is not null pass through uncounted, spread over
    the buckets by ``seq``.
    """
    tx = tx.fillna("", [r.key for r in rules])
    schema = tx.schema
    # Python reads what it counts by; all other columns cross as one string.
    read = list(dict.fromkeys([*(r.key for r in rules), "ts_ms", "seq", *([skip] if skip else [])]))
    rest = [f for f in schema.fields if f.name not in read]
    carried = F.to_json(F.struct(*[f.name for f in rest]), _CARRIED).alias("carried")
    buckets_of = []
    for rule in rules:
        bucket = bucket_of(F.col(rule.key), buckets)
        if skip is not None:
            bucket = F.when(F.col(skip).isNull(), bucket).otherwise(F.pmod(F.xxhash64("seq"), F.lit(buckets)).cast("int"))
        buckets_of.append(bucket.alias(f"_bucket_{len(buckets_of)}"))
    if rules:
        fields = [*tx.select(*read, carried).schema.fields, *(T.StructField(r.out, T.LongType()) for r in rules)]
        # The micro-batch's own time, which its log keeps: a repeat of it sees the same clock.
        rows = tx.select(F.unix_millis(F.current_timestamp()).alias("_now"), *read, carried, *buckets_of)
        tx = rows.mapInArrow(_pack_rows(rows.columns[1:], "_bucket_0"), _PACKED)
        names = rows.columns[1 : len(read) + 2]
        for k, rule in enumerate(rules):
            later = [f"_bucket_{x}" for x in range(k + 1, len(rules))]
            done = [r.out for r in rules[:k]]
            tx = tx.groupBy("_bucket").transformWithStateInPandas(
                WindowCounter(rule, [*names, *later, *done], retention_ms, skip, idle_ms, later[0] if later else None),
                outputStructType=_PACKED,
                outputMode="append",
                timeMode="None",
            )
        tx = tx.mapInArrow(_unpack_rows, T.StructType(fields))
    else:
        tx = tx.select(*read, carried)
    whole = tx.withColumn("carried", F.from_json("carried", T.StructType(rest), _CARRIED))
    counted = [r.out for r in rules]
    return whole.select(*[F.col(n) if n in read else F.col("carried")[n].alias(n) for n in schema.names], *counted)


def use_rocksdb(spark) -> None:
    """Session options of the stateful queries; call before one starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("ticks").to_pylist()):
            ticks = Ticks.unpack(data)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(bucket, pa.int32()), len(ticks)), ticks.key, pa.array(ticks.ms), pa.array(ticks.n)], ["bucket", "key", "ts_ms", "n"])


def read_state(spark: SparkSession, checkpoint: str, operator: int) -> DataFrame:
    """(bucket, key, ts_ms, n) of the ticks that a checkpoint holds for its ``operator``-th rule, the last rule being 0."""
    stored = spark.read.format("statestore").option("operatorId", str(operator)).option("stateVarName", "blocks").load(checkpoint)
    blocks = stored.select(F.col("key")["_bucket"].alias("bucket"), F.col("user_map_value")["ticks"].alias("ticks"))
    return blocks.mapInArrow(_rows_of, "bucket int, key string, ts_ms long, n long")
