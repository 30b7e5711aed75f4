"""What must not grow with the tables, on tables that are small."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import arrival_counts, verdict, verdicts
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter
from test_stream import Map

from cardwatch.operators.velocity import WindowRule
from cardwatch.plans import fixture, streams
from cardwatch.session import fresh_path
from cardwatch.sources import record_log
from cardwatch.sources.records import body_stream, file_records
from cardwatch.streaming.job import ingest_bodies
from cardwatch.streaming import velocity as state
from cardwatch.streaming.snapshots import SnapshotLog

DATA = "/root/testdata/sf0.001"


def test_a_longer_log_is_not_read_in_more_micro_batches(spark, monkeypatch):
    monkeypatch.setattr(streams, "READ_OFFSETS", (100, 5_000_000))
    queries, real = [], streams.record_log.stream

    def stream(session, log, position, limit):
        queries.append((limit, streams.record_log.heads(session, log).groupBy().sum("high_watermark").first()[0]))
        return real(session, log, position, limit)

    monkeypatch.setattr(streams.record_log, "stream", stream)
    got = streams.read_log(spark, DATA).collect()
    (limit, held), = queries
    assert held / limit <= streams.READ_BATCHES < held / 100
    assert sum(r.n for r in got) == 1000 + 25 and all(r.n == r.offsets for r in got)


def test_counters_are_added_up_in_many_tasks_and_meet_as_sums(spark, monkeypatch):
    """No single task adds up the partitions of a shuffle one after the other, with a table for each."""
    plans, real = [], DataFrameWriter.parquet

    def parquet(writer, *args, **how):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return real(writer, *args, **how)

    rows = verdicts(spark, [verdict(f"t{k}", k, 1_700_000_000_000 + k * 700) for k in range(100)])
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    log = SnapshotLog(spark, fresh_path(spark, "log"), fold_after=1)
    for batch in range(3):
        log.write(rows, "run", batch)
    record_log.append(fixture.raw_records(spark, DATA, broken=False), fresh_path(spark, "records"))
    monkeypatch.undo()
    counted = [p for p in plans if "HashAggregate" in p]
    assert len(counted) >= 5 and not any("Coalesce" in p for p in counted)
    assert {r.n for r in log.read()[0].filter("kind = 'decision'").collect()} == {3 * 40, 3 * 30}


def test_more_bodies_are_not_more_files(spark, monkeypatch):
    files, real = [], streams.ingest_bodies

    def ingest(bodies, path, checkpoint, **trigger):
        query = real(bodies, path, checkpoint, **trigger)
        query.awaitTermination()
        files.append(sum(p["numInputRows"] for p in query.recentProgress))
        return query

    made, source = [], streams.body_stream
    monkeypatch.setattr(streams, "body_stream", lambda session, path, *args, **how: made.append(path) or source(session, path, *args, **how))
    monkeypatch.setattr(streams, "ingest_bodies", ingest)
    got = {r.body_no: r for r in streams.ingested_bodies(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 100 and {n for n, r in got.items() if r.cause} == set(range(4, 100, 9))
    assert all(r.n == (0 if r.cause else 100) for r in got.values())
    assert len(set(spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(made[0]).inputFiles())) <= 2 * streams.FILES
    assert len(files) == 2


def test_a_file_can_be_one_body(spark, tmp_path):
    for k, text in enumerate(['[{"id":"a","amount":1}]', '[{"id":5}]']):
        (tmp_path / f"{k}.json").write_text(text)
    base = fresh_path(spark, "one")
    ingest_bodies(body_stream(spark, str(tmp_path)), base, f"{base}/checkpoint", availableNow=True).awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{base}/transactions").collect()] == ["a"]
    refused, = spark.read.parquet(f"{base}/refused").collect()
    assert refused.body.endswith("/1.json") and refused.cause == "id is not a string"


def test_records_of_few_files_are_decoded_in_many_tasks(spark, monkeypatch):
    path = fresh_path(spark, "records")
    spark.range(2000).select(
        F.lit(b"k").alias("key"), F.lit("{}").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(0).cast("timestamp").alias("timestamp")
    ).coalesce(1).write.parquet(path)
    seen = []

    class Seen(Exception):
        pass

    def note(raw):
        seen.append(raw)
        raise Seen

    monkeypatch.setattr(streams, "file_records", lambda session, source, **_: file_records(session, source, streaming=False))
    monkeypatch.setattr(streams, "decode", note)
    with pytest.raises(Seen):
        streams._counted(spark, (path, 1), fresh_path(spark, "counted"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = seen[0].groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == 2000 and max(r["count"] for r in tasks) < 700


def test_rows_meet_the_state_in_packed_tables(monkeypatch):
    r = random.Random(3)
    rows = [(f"k{r.randrange(9)}", 1_700_000_000_000 + r.randrange(200_000), k, r.randrange(8), r.randrange(5)) for k in range(4000)]
    names = ["key", "ts_ms", "seq", "_bucket_0", "_bucket_1"]
    table = pa.table({"_now": [7] * len(rows), **{n: [x[i] for x in rows] for i, n in enumerate(names)}})
    batches = table.to_batches(max_chunksize=300)
    packed = pa.Table.from_batches(state._pack_rows(names, "_bucket_0")(iter(batches)))
    assert sorted(packed["_bucket"].to_pylist()) == list(range(8))  # one table a bucket, not a row of Spark's for each of ours
    monkeypatch.setattr(state, "PACK_ROWS", 50)
    got = {}
    for bucket in range(8):
        counter = state.WindowCounter(WindowRule("key", 60_000, "n"), ["key", "ts_ms", "seq", "_bucket_1"], None, then="_bucket_1")
        counter.blocks, counter.came = Map(), Map()
        frame = packed.filter(pc.equal(packed["_bucket"], bucket)).to_pandas()
        for out in counter.handleInputRows((bucket,), iter([frame]), None):
            for now, data, then in out.itertuples(index=False):
                part = state._unpacked(data).to_pylist()
                assert now == 7 and 0 < len(part) <= 50
                got.update({x["seq"]: (x["key"], x["ts_ms"], then, x["n"]) for x in part})
    want = {}
    for bucket in range(8):
        mine = sorted((x for x in rows if x[3] == bucket), key=lambda x: (x[1], x[2]))
        for x, n in zip(mine, arrival_counts([x[:2] for x in mine], 60_000)):
            want[x[2]] = (x[0], x[1], x[4], n)
    assert got == want
