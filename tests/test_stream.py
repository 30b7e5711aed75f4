import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from helpers import arrival_counts
from pyspark.sql import functions as F

from cardwatch import schemas
from cardwatch.operators.audit import delivery_audit, missing_verdicts, window_loss_audit
from cardwatch.session import fresh_path
from cardwatch.sources.records import file_records
from cardwatch.sources.sinks import CaseTable
from cardwatch.streaming.job import ScoringJob, deduplicated, read_throughput, write_throughput
from cardwatch.streaming.snapshots import read_snapshot
from cardwatch.operators.velocity import WindowRule
from cardwatch.streaming.velocity import Ticks, WindowCounter, read_state, stream_velocity, use_rocksdb

T0 = 1_700_000_000_000


class Map:
    """A map state in memory that notes what is read and written."""

    def __init__(self):
        self.held, self.read, self.written, self.gone = {}, [], [], []

    def iterator(self):
        return iter(list(self.held.items()))

    def getValue(self, key):
        self.read.append(key[0])
        return self.held[key]

    def updateValue(self, key, value):
        self.written.append(key[0])
        self.held[key] = value

    def removeKey(self, key):
        self.gone.append(key[0])
        del self.held[key]


class Bucket:
    def __init__(self, window=60_000, retention_ms=None, idle_ms=0):
        self.counter = WindowCounter(WindowRule("key", window, "n"), [], retention_ms, idle_ms=idle_ms)
        self.counter.blocks, self.counter.came = self.blocks, self.came = Map(), Map()

    def add(self, batch, now=T0):
        rows = sorted(batch, key=lambda r: r[1])
        return self.counter._count(pd.DataFrame(rows, columns=["key", "ts_ms"]), now).tolist()

    def ticks(self):
        return Ticks.join([Ticks.unpack(v[0]) for v in self.blocks.held.values()])


@pytest.mark.parametrize("seed", range(12))
def test_state_equals_one_at_a_time(seed):
    rnd = random.Random(seed)
    late = seed % 3
    bucket, got, events = Bucket(), [], []
    for b in range(25):
        start = 30_000 * (b if not late else rnd.randrange(14) if late == 1 else max(0, b - rnd.choice((0, 0, 1, 6))))
        batch = [(f"k{rnd.randrange(5)}", T0 + start + rnd.randrange(40) * 1000) for _ in range(rnd.randrange(1, 40))]
        got += bucket.add(batch)
        events += sorted(batch, key=lambda r: r[1])
    assert got == arrival_counts(events, 60_000)
    # At most one entry per key and millisecond.
    held = bucket.ticks()
    assert len(set(zip(held.key.to_pylist(), held.ms.tolist()))) == len(held)


def test_a_micro_batch_touches_its_own_blocks_only():
    bucket = Bucket()
    size = 60_000
    for b in range(10):
        bucket.add([("a", T0 // size * size + b * size), ("b", T0 // size * size + b * size + 5)])
    first = T0 // size
    assert sorted(k[0] for k in bucket.blocks.held) == list(range(first, first + 10))
    bucket.blocks.read.clear(), bucket.blocks.written.clear()
    assert bucket.add([("a", (first + 9) * size + 7)]) == [2]
    assert bucket.blocks.read == [first + 8, first + 9] and bucket.blocks.written == [first + 9]


def test_old_blocks_go_whole_and_unread():
    bucket = Bucket(retention_ms=600_000, idle_ms=1000)
    bucket.add([("old", T0)], now=T0)
    bucket.blocks.read.clear()
    bucket.add([("new", T0 + 700_000)], now=T0 + 999)  # rows came too lately
    assert "old" in bucket.ticks().key.to_pylist()
    bucket.blocks.read.clear()
    bucket.add([("new", T0 + 700_001)], now=T0 + 700_000)
    assert set(bucket.ticks().key.to_pylist()) == {"new"}
    assert bucket.blocks.gone == [T0 // 60_000] and T0 // 60_000 not in bucket.blocks.read
    # An event that claims to be from the future does not make the others old.
    bucket = Bucket(retention_ms=600_000, idle_ms=0)
    bucket.add([("k", T0)], now=T0)
    bucket.add([("far", T0 + 10**12)], now=T0 + 1)
    assert bucket.add([("k", T0 + 10)], now=T0 + 2) == [2]


def test_a_repeated_micro_batch_sees_the_same_clock():
    """What goes depends on the time of the micro-batch and on nothing else."""
    def run(now):
        bucket = Bucket(retention_ms=0, idle_ms=1000)
        bucket.add([("a", T0)], now=T0)
        bucket.add([("b", T0 + 400_000)], now=now)
        return sorted(bucket.ticks().key.to_pylist())

    assert run(T0 + 999) == ["a", "b"] and run(T0 + 1000_000) == ["b"]
    assert run(T0 + 1000_000) == run(T0 + 1000_000)


# ---- the job -----------------------------------------------------------------


def record(i, **over):
    body = dict(
        id=f"tx_{i}", card_bin="520082", card_hash=f"tok_{i}", amount=9999.0, currency="SEK", country="SE",
        ip=f"10.9.{i // 200}.{i % 200}", merchant_id="m", mcc="5411",
    )
    at = dt.datetime.fromtimestamp((T0 + i) / 1000, dt.timezone.utc)
    body.update({k: v for k, v in over.items() if k != "ts"})
    at = over.get("ts", at)
    body["timestamp"] = at.isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return (bytearray(body["card_hash"].encode()), json.dumps(body), "transactions", i % 6, i, at)


def append(spark, path, rows):
    spark.createDataFrame(rows, schemas.RAW_RECORD).coalesce(1).write.mode("append").parquet(path)


def job(base, **kw):
    return ScoringJob(
        checkpoint=f"{base}/checkpoint",
        verdict_path=f"{base}/verdicts",
        case_path=f"{base}/cases",
        dead_path=f"{base}/dead",
        snapshot_path=f"{base}/snapshot",
        buckets=8,
        wall_clock=False,
        **kw,
    )


def run(spark, job_, source):
    job_.start(file_records(spark, source, max_files_per_trigger=1), availableNow=True).awaitTermination()


def verdict_rows(spark, base):
    return spark.read.schema(schemas.VERDICT).parquet(f"{base}/verdicts")


def test_crash_between_sinks_loses_nothing(spark):
    """A sink that fails stops the query before the commit; the restart repeats the batch."""
    source, base = fresh_path(spark, "src"), fresh_path(spark, "crash")
    append(spark, source, [record(i) for i in range(60)])
    append(spark, source, [record(i) for i in range(60, 120)] + [(bytearray(b"k"), "{oops", "transactions", 1, 999, dt.datetime(2024, 1, 1))])
    failures = []

    def flaky(rows, batch):
        if batch == 1 and not failures:
            failures.append(batch)
            raise RuntimeError("sink is down")

    seen = []
    hooks = dict(on_flagged=[lambda rows, batch: seen.append((batch, rows.count())), flaky])
    with pytest.raises(Exception, match="sink is down"):
        run(spark, job(base, **hooks), source)
    append(spark, source, [record(i) for i in range(120, 180)])
    run(spark, job(base, **hooks), source)
    expected = spark.range(180).select(F.concat(F.lit("tx_"), "id").alias("tx_id"))
    got = verdict_rows(spark, base)
    assert missing_verdicts(expected, got).count() == 0
    assert tuple(delivery_audit(got).first()) == (180, 180, 0)
    assert [b for b, _ in seen].count(1) == 2  # at least once for hooks, exactly once for the numbered parts
    assert CaseTable(spark, f"{base}/cases").open().count() == 180
    assert spark.read.parquet(f"{base}/dead").count() == 1
    stats, recent = read_snapshot(spark, f"{base}/snapshot")
    row = stats.first()
    assert (row.processed, row.reviewed, row.rule_fires["amount_extreme"]) == (180, 180, 180)
    assert (row.flagged_rate, recent.count()) == (1.0, 64)


def test_windows_survive_a_restart(spark):
    """17 cards, nine rounds, a stop, four rounds inside the window: none is lost."""
    source, base = fresh_path(spark, "src"), fresh_path(spark, "restart")

    def rounds(first, last):
        return [
            record(
                n * 17 + card,
                card_hash=f"card{card:02d}",
                ts=dt.datetime.fromtimestamp(T0 / 1000 + n * 3 + card / 100, dt.timezone.utc),
            )
            for n in range(first, last)
            for card in range(17)
        ]

    append(spark, source, rounds(0, 9))
    run(spark, job(base), source)
    warm = verdict_rows(spark, base).count()
    append(spark, source, rounds(9, 13))
    run(spark, job(base), source)
    after = verdict_rows(spark, base).filter(f"at >= {T0 + 27_000}")
    assert (warm, after.count()) == (153, 68)
    index = F.regexp_extract("tx_id", r"(\d+)$", 1).cast("int") % 17
    audit = window_loss_audit(after.withColumn("card_hash", index), "card_velocity_extreme")
    assert tuple(audit.first()) == (0, 17)


def test_dedupe_and_rates_on_streams(spark):
    path, base = fresh_path(spark, "verdicts"), fresh_path(spark, "dedupe")
    ddl = "tx_id string, at bigint"
    spark.createDataFrame([("a", T0), ("b", T0 + 1)], ddl).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("a", T0), ("c", T0 + 2)], ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(path)
    query = deduplicated(stream).writeStream.option("checkpointLocation", base).trigger(availableNow=True)
    query.format("parquet").start(f"{base}-out").awaitTermination()
    assert sorted(r.tx_id for r in spark.read.parquet(f"{base}-out").collect()) == ["a", "b", "c"]

    rates = stream.withColumnRenamed("at", "ts_ms")
    write_throughput(rates, f"{base}-rates", f"{base}-rate", availableNow=True).awaitTermination()
    assert [tuple(r) for r in read_throughput(spark, f"{base}-rates").collect()] == [(T0 // 1000, 4)]


def test_late_rows_are_kept_by_dedupe_and_rates(spark):
    path, base = fresh_path(spark, "verdicts"), fresh_path(spark, "late")
    ddl = "tx_id string, at bigint"
    hours = 3_600_000
    for rows in ([(f"n{k}", T0 + 5 * hours) for k in range(4)], [(f"o{k}", T0 + k) for k in range(7)] + [("n0", T0 + 5 * hours)], [("o1", T0 + 1)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(path)
    query = deduplicated(stream).writeStream.option("checkpointLocation", base).trigger(availableNow=True)
    query.format("parquet").start(f"{base}-out").awaitTermination()
    got = sorted(r.tx_id for r in spark.read.parquet(f"{base}-out").collect())
    assert got == sorted([f"n{k}" for k in range(4)] + [f"o{k}" for k in range(7)])
    write_throughput(stream.withColumnRenamed("at", "ts_ms"), f"{base}-rates", f"{base}-rate", availableNow=True).awaitTermination()
    assert {tuple(r) for r in read_throughput(spark, f"{base}-rates").collect()} == {(T0 // 1000, 8), ((T0 + 5 * hours) // 1000, 5)}


def test_snapshot_path_can_join_a_running_checkpoint(spark):
    source, base = fresh_path(spark, "src"), fresh_path(spark, "joined")
    append(spark, source, [record(i) for i in range(10)])
    quiet = job(base)
    quiet.snapshot_path = None
    run(spark, quiet, source)
    append(spark, source, [record(i) for i in range(10, 25)] + [(bytearray(b"k"), "{oops", "transactions", 1, 99, dt.datetime(2024, 1, 1))])
    sent = {}
    told = job(base, verdict_topic="verdicts", dead_topic="dead", send=lambda m, t: sent.__setitem__(t, m.collect()))
    run(spark, told, source)
    assert read_snapshot(spark, f"{base}/snapshot")[0].first().processed == 15
    assert sorted(json.loads(r.value)["tx_id"] for r in sent["verdicts"]) == sorted(f"tx_{i}" for i in range(10, 25))
    assert [bytes(r.value) for r in sent["dead"]] == [b"{oops"]
    with pytest.raises(ValueError):
        ScoringJob(checkpoint=base, verdict_topic="verdicts")


def test_late_rows_count_alike_for_any_bucket_layout():
    """Two keys in one bucket or apart: a late row of the first finds its ticks."""
    minutes = 60_000
    first, second, late = [("a", T0)], [("b", T0 + 20 * minutes)], [("a", T0 + 1000)]

    def together(*batches):
        bucket = Bucket(retention_ms=600_000, idle_ms=600_000)
        return [n for now, batch in enumerate(batches) for n in bucket.add(batch, now=T0 + 30 * minutes + now)]

    assert together(first, second, late)[-1] == together(first, late)[-1] == 2


@pytest.mark.parametrize("buckets", [8, 64])
def test_columns_come_back_as_they_were_and_state_can_be_read(spark, buckets):
    source, base = fresh_path(spark, "rows"), fresh_path(spark, "carried")
    ddl = "card_hash string, ip string, ts_ms long, seq long, at timestamp, plain timestamp_ntz, part struct<x: double, y: array<timestamp>>"
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 123456, tzinfo=dt.timezone.utc)
    naive = dt.datetime(1999, 12, 31, 23, 59, 59, 1)
    rows = [(f"c{i % 4}", "i" if i % 3 else None, T0 + i * 25_000, i, at, naive, (0.1, [at])) for i in range(12)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(source)
    use_rocksdb(spark)
    stream = spark.readStream.schema(ddl).parquet(source)
    out = stream_velocity(stream, buckets=buckets, retention_ms=None)
    out.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{base}/out").awaitTermination()
    got = spark.read.parquet(f"{base}/out").orderBy("seq").collect()
    assert len(got) == 12
    same = spark.read.parquet(f"{base}/out").filter(
        (F.unix_micros("at") % 1_000_000 == 123456) & (F.date_format("plain", "ss.SSSSSS") == "59.000001") & (F.unix_micros(F.col("part.y")[0]) % 1_000_000 == 123456)
    )
    assert same.count() == 12
    assert [r.card_n for r in got] == arrival_counts([(r[0], r[2]) for r in rows], 60_000)
    cards, ips = (read_state(spark, f"{base}/checkpoint", k) for k in (1, 0))
    assert {(r.key, r.ts_ms, r.n) for r in ips.collect()} == {(r[1] or "", r[2], 1) for r in rows if r[2] >= T0 + 11 * 25_000 - 300_000} | {
        (r[1] or "", r[2], 1) for r in rows if r[2] >= max(x[2] for x in rows if x[1] == r[1]) - 300_000
    }
    newest = {r[0]: r[2] for r in rows}
    assert {(r.key, r.ts_ms) for r in cards.collect()} == {(r[0], r[2]) for r in rows if r[2] >= newest[r[0]] - 60_000}
