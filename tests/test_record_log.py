import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardwatch import schemas
from cardwatch.operators.lag import lag_total, partition_lag
from cardwatch.session import fresh_path
from cardwatch.sources import record_log
from cardwatch.sources.sinks import run_of
from cardwatch.streaming.progress import LagRecorder, recorded

AT = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def append(spark, path, offsets, **how):
    rows = [(None if o % 5 == 0 else bytearray(b"k%d" % o), None if o % 7 == 0 else f"v{o}", t, p, o, AT + dt.timedelta(microseconds=o)) for t, p, o in offsets]
    record_log.append(spark.createDataFrame(rows, schemas.RAW_RECORD), path, **how)


def start(spark, log, base, limit, write):
    rows = record_log.stream(spark, log, f"{base}/position.json", limit)
    return rows.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()


def lags(spark, base):
    rows = partition_lag(recorded(spark, f"{base}/lag", run_of(spark, f"{base}/checkpoint")))
    return {r.partition: r.lag for r in rows.collect()}, lag_total(rows).first()[0]


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.sampled_from("ab"), st.dictionaries(st.sampled_from("012"), st.integers(0, 90), min_size=1), min_size=1),
    st.integers(1, 50),
)
def test_admission_reaches_every_head_and_never_passes_it(heads, limit):
    at, rounds = {}, 0
    while at != heads:
        end = record_log.admitted(at, heads, limit)
        moved = {(t, p): end[t][p] - at.get(t, {}).get(p, 0) for t in heads for p in heads[t]}
        assert all(0 <= n for n in moved.values()) and all(end[t][p] <= heads[t][p] for t, p in moved)
        # A partition gets its share rounded up.
        assert sum(moved.values()) <= limit + len(moved)
        assert sum(moved.values()) or end == heads
        at, rounds = end, rounds + 1
        assert rounds < 200


def test_records_come_once_through_a_failed_batch_and_restarts(spark):
    log, base = fresh_path(spark, "log"), fresh_path(spark, "read")
    append(spark, log, [("x", p, o * 3) for p in range(3) for o in range(40)] + [("y", 0, 7)], segment_rows=9)
    assert record_log.segments(spark, log).count() == 3 * 5 + 1
    seen, failed = {}, []

    def write(rows, batch):
        got = [(r.topic, r.partition, r.offset, r.value, None if r.key is None else bytes(r.key), r.timestamp) for r in rows.collect()]
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("sink is down")
        seen[batch] = got

    for turn in range(9):
        if turn == 3:
            append(spark, log, [("x", 1, 200), ("x", 4, 0)])
        try:
            start(spark, log, base, 100, write).awaitTermination()
        except Exception as fault:  # noqa: BLE001
            assert "sink is down" in str(fault)
    rows = [r for batch in seen.values() for r in batch]
    want = [("x", p, o * 3) for p in range(3) for o in range(40)] + [("y", 0, 7), ("x", 1, 200), ("x", 4, 0)]
    assert failed and sorted(r[:3] for r in rows) == sorted(want)
    assert len(seen) > 3 and max(len(b) for b in seen.values()) < 60
    for _, _, o, value, key, at in rows:
        assert value == (None if o % 7 == 0 else f"v{o}") and key == (None if o % 5 == 0 else b"k%d" % o)
        assert at.microsecond == o
    assert sorted((r.topic, r.partition, r.offset) for r in record_log.read(spark, log).collect()) == sorted(want)
    # A batch reads the positions of its own partitions in order, one split each.
    assert all([x[2] for x in b if x[:2] == k] == sorted(x[2] for x in b if x[:2] == k) for b in seen.values() for k in {x[:2] for x in b})


def test_an_append_without_its_index_row_is_not_there(spark):
    log = fresh_path(spark, "log")
    append(spark, log, [("x", 0, o) for o in range(5)])
    spark.createDataFrame([(None, "torn", "x", 0, 99, AT)], schemas.RAW_RECORD).write.partitionBy("topic", "partition").parquet(f"{log}/segments/append=torn")
    assert record_log.read(spark, log).count() == 5
    assert record_log.heads(spark, log).first().high_watermark == 5
    reader = record_log.RecordLogReader({"path": log, "position": f"{fresh_path(spark, 'p')}/position.json"})
    assert reader.latestOffset() == {"x": {"0": 5}}
    assert record_log.RecordLogReader({"path": f"{log}-none", "position": f"{log}-p"}).latestOffset() == {}


def test_lag_is_live_survives_a_restart_and_leaves_unread_partitions_out(spark):
    log, base = fresh_path(spark, "log"), fresh_path(spark, "lag")
    append(spark, log, [("x", p, o) for p in range(2) for o in range(100)])
    during = []

    def write(rows, batch):
        rows.count()
        if batch == 1:
            during.append(lags(spark, base))

    def once():
        recorder = LagRecorder(spark, f"{base}/lag", lambda: record_log.heads(spark, log))
        spark.streams.addListener(recorder)
        try:
            start(spark, log, base, 100, write).awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        finally:
            spark.streams.removeListener(recorder)

    once()
    assert lags(spark, base) == ({0: 50, 1: 50}, 100)
    # Partition 5 has no record yet that was read; partition 1 is at its head after the next batch.
    append(spark, log, [("x", 0, 100 + o) for o in range(300)] + [("x", 5, 0)])
    once()  # a listener of its own, as after a restart
    assert during == [({0: 50, 1: 50}, 100)]  # readable while the query runs
    seen, total = lags(spark, base)
    assert seen == {0: 350 - 88, 1: 50 - 13, 5: 0} and total == sum(seen.values())
    files = spark.read.parquet(f"{base}/lag").inputFiles()
    assert len(files) <= 2
    assert recorded(spark, f"{base}/lag", "nobody").count() == 0


def test_a_partition_that_was_never_read_is_absent(spark):
    report = '{"batchId": 3, "sources": [{"startOffset": null, "endOffset": {"x": {"0": 5, "1": 0}}, "latestOffset": {"x": {"0": 5, "1": 0}}}]}'
    from cardwatch.streaming.progress import observations

    heads = spark.createDataFrame([("x", 0, 9), ("x", 1, 4)], "topic string, partition int, high_watermark long")
    rows = observations(spark, [report], heads)
    assert {(r.partition, r.high_watermark, r.last_offset) for r in rows.collect()} == {(0, 9, 4), (1, 4, -1)}
    assert [tuple(r) for r in partition_lag(rows).collect()] == [(0, 4)]
    assert rows.filter(F.col("topic") != "x").count() == 0
