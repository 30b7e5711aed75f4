"""The scoring stream: records in, verdicts, cases, dead letters and counters out.

One query reads, decodes, scores and writes. Offsets are committed after every
sink of the micro-batch has returned, so a crash repeats a micro-batch and
never loses one. Every sink writes a part named after the batch id, so a
repeated micro-batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardwatch import schemas
from cardwatch.functions.rules import DEFAULT_RULES, Rule
from cardwatch.operators.scoring import flagged, score_counted, verdict_struct
from cardwatch.sources.records import dead_letter_struct, decode, read_bodies
from cardwatch.sources.sinks import CaseTable, overwrite_part, run_of, to_kafka, verdict_messages, with_message_id
from cardwatch.streaming.snapshots import SnapshotLog
from cardwatch.streaming.velocity import RETENTION_MS, STATE_BUCKETS, stream_velocity, use_rocksdb

Hook = Callable[[DataFrame, int], None]


def _stream_rows(decoded: DataFrame) -> DataFrame:
    """Transactions and undecodable records in one frame, told apart by ``cause``.

    A bad record has zero values in place of a transaction, so no number is
    null on the way through the counters; a good one drops its raw bytes.
    """
    bad = F.col("cause").isNotNull()
    fields = []
    for field_ in schemas.TRANSACTION:
        value = F.col("tx")[field_.name]
        if field_.name == "timestamp":
            value = F.coalesce(value, F.col("timestamp"))
        else:
            value = F.coalesce(value, F.lit(0.0 if field_.name == "amount" else ""))
        fields.append(value.alias(field_.name))
    raw = [F.when(bad, F.col(c)).alias(f"raw_{c}") for c in ("key", "value")]
    rows = decoded.select(
        *fields,
        *raw,
        "topic",
        "partition",
        F.col("offset").alias("seq"),
        F.unix_micros("timestamp").alias("arrived"),
        "cause",
    )
    return rows.withColumn("ts_ms", F.unix_millis("timestamp")).drop("timestamp")


def scored_stream(
    raw: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    bins: DataFrame | None = None,
    retention_ms: int | None = RETENTION_MS,
    buckets: int = STATE_BUCKETS,
    wall_clock: bool = True,
) -> DataFrame:
    """One row per record: ``verdict`` for a scored one, ``dead`` for an undecodable one.

    With ``wall_clock`` the verdict is stamped with the current time and the
    delay since the record arrived; without it, with the event time and zero.
    """
    rows = _stream_rows(decode(raw))
    counted = stream_velocity(rows, retention_ms=retention_ms, buckets=buckets, skip="cause")
    scored = score_counted(counted, rules, bins)
    at: Column | None = None
    delay: Column | None = None
    if wall_clock:
        at = F.unix_millis(F.current_timestamp())
        delay = F.unix_micros(F.current_timestamp()) - F.col("arrived")
    verdict = verdict_struct(delay, at)
    dead = dead_letter_struct(F.col("raw_key"), F.col("raw_value"), F.col("seq"))
    good = F.col("cause").isNull()
    return scored.select(F.when(good, verdict).alias("verdict"), F.when(~good, dead).alias("dead"))


def part_sink(path: str, run: str) -> Hook:
    return lambda rows, batch: overwrite_part(rows, path, run, batch)


def case_sink(path: str, run: str) -> Hook:
    def write(rows: DataFrame, batch: int) -> None:
        CaseTable(rows.sparkSession, path).add(f"{run}-{batch}", rows)

    return write


def topic_sink(
    topic: str, send: Callable[[DataFrame, str], None], run: str, messages: Callable[[DataFrame], DataFrame] | None = None
) -> Hook:
    """Rows as messages of a topic. A repeated micro-batch sends them again under the same names (``received_once``)."""
    return lambda rows, batch: send(with_message_id(messages(rows) if messages else rows, run, batch), topic)


def snapshot_sink(path: str, run: str) -> Hook:
    """Counters, rates and newest feed rows of each micro-batch, in a log that folds itself."""
    return lambda rows, batch: SnapshotLog(rows.sparkSession, path).write(rows, run, batch)


@dataclass
class ScoringJob:
    """Where the stream writes. A path left out switches that sink off.

    ``on_flagged`` hooks get every flagged verdict of a micro-batch,
    ``on_scored`` hooks every verdict and ``on_dead`` hooks every undecodable
    record. ``verdict_topic`` and ``dead_topic`` send the same rows to topics
    through ``send(messages, topic)``, by default to the brokers in ``servers``.
    """

    checkpoint: str
    verdict_path: str | None = None
    case_path: str | None = None
    dead_path: str | None = None
    snapshot_path: str | None = None
    on_flagged: list[Hook] = field(default_factory=list)
    on_scored: list[Hook] = field(default_factory=list)
    on_dead: list[Hook] = field(default_factory=list)
    verdict_topic: str | None = None
    dead_topic: str | None = None
    servers: str | None = None
    send: Callable[[DataFrame, str], None] | None = None
    rules: Sequence[Rule] = DEFAULT_RULES
    bins: DataFrame | None = None
    retention_ms: int | None = RETENTION_MS
    buckets: int = STATE_BUCKETS
    wall_clock: bool = True

    def __post_init__(self) -> None:
        if self.send is None and (self.verdict_topic or self.dead_topic):
            if not self.servers:
                raise ValueError("a topic needs servers or a send function")
            self.send = lambda messages, topic: to_kafka(messages, self.servers, topic)

    def _sinks(self, run: str) -> tuple[list[Hook], list[Hook], list[Hook]]:
        """Sinks of scored, flagged and undecodable rows."""
        scored = [snapshot_sink(self.snapshot_path, run)] if self.snapshot_path else []
        hot = [part_sink(self.verdict_path, run)] if self.verdict_path else []
        hot += [case_sink(self.case_path, run)] if self.case_path else []
        hot += [topic_sink(self.verdict_topic, self.send, run, verdict_messages)] if self.verdict_topic else []
        dead = [part_sink(self.dead_path, run)] if self.dead_path else []
        dead += [topic_sink(self.dead_topic, self.send, run)] if self.dead_topic else []
        return [*scored, *self.on_scored], [*hot, *self.on_flagged], [*dead, *self.on_dead]

    def handle(self, rows: DataFrame, batch: int) -> None:
        """Write one micro-batch to every sink; an error leaves it uncommitted.

        The sinks are independent, so their jobs are submitted side by side.
        """
        rows = rows.persist()
        rows.count()  # run the stateful part once, before the sinks share it
        scored = rows.filter("verdict IS NOT NULL").select("verdict.*")
        hot = flagged(scored)
        dead = rows.filter("dead IS NOT NULL").select("dead.*")
        on_scored, on_flagged, on_dead = self._sinks(run_of(rows.sparkSession, self.checkpoint))
        writes = [*((x, scored) for x in on_scored), *((x, hot) for x in on_flagged), *((x, dead) for x in on_dead)]
        try:
            if writes:
                with ThreadPoolExecutor(len(writes)) as pool:
                    for done in [pool.submit(sink, part, batch) for sink, part in writes]:
                        done.result()
        finally:
            rows.unpersist()

    def start(self, raw: DataFrame, **trigger) -> StreamingQuery:
        """Run over a record stream; ``trigger`` as in ``DataStreamWriter.trigger``."""
        use_rocksdb(raw.sparkSession)
        rows = scored_stream(raw, self.rules, self.bins, self.retention_ms, self.buckets, self.wall_clock)
        return (
            rows.writeStream.outputMode("append")
            .option("checkpointLocation", self.checkpoint)
            .foreachBatch(self.handle)
            .trigger(**(trigger or {"processingTime": "400 milliseconds"}))
            .start()
        )


def deduplicated(verdict_stream: DataFrame, keep: str = "7 days") -> DataFrame:
    """One verdict per id on a stream of verdicts, however late it comes.

    Ids stay in state for ``keep`` of processing time: the watermark runs on
    the time of arrival, so no row is ever late, and an id that comes again
    after that passes once more. For consumers, after scoring: a repeated
    transaction must still advance the windows.
    """
    arrived = verdict_stream.withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["tx_id"]).drop("_arrived")


def per_second(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.floor(F.col("ts_ms") / 1000).cast("bigint").alias("second")).agg(F.count("*").alias("n"))


def write_throughput(tx: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Transactions per second of event time, counted by micro-batch; ``read_throughput`` adds the parts up, so no row is too late."""

    def write(rows: DataFrame, batch: int) -> None:
        overwrite_part(per_second(rows), path, run_of(rows.sparkSession, checkpoint), batch)

    return (
        tx.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema("second bigint, n bigint").parquet(path)
    return parts.groupBy("second").agg(F.sum("n").cast("bigint").alias("n"))


def ingest_bodies(bodies: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Request bodies (body, value) as a stream: transactions of the good ones, and the refused ones whole, in tables of their own.

    An absent time is the time of the micro-batch. A repeated micro-batch
    replaces its own parts.
    """

    def write(rows: DataFrame, batch: int) -> None:
        good, bad = read_bodies(rows)
        run = run_of(rows.sparkSession, checkpoint)
        overwrite_part(good, f"{path}/transactions", run, batch)
        overwrite_part(bad, f"{path}/refused", run, batch)

    return (
        bodies.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
