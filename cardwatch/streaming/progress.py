"""Consumer lag of a streaming query: from its progress reports, and live while it runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.utils import AnalysisException

_OFFSETS = "map<string,map<string,bigint>>"
_STATE = "topic string, partition int, seq long, high_watermark long, last_offset long"


def observations(spark: SparkSession, progress_json: Iterable[str], heads: DataFrame | None = None) -> DataFrame:
    """Lag observations from progress reports (``StreamingQueryProgress.json``).

    The input is one small report per micro-batch. A source offset maps topic
    to partition to the next offset to read; a partition that did not advance
    is an empty fetch. The head of a partition is the ``latestOffset`` of the
    report, or that of ``heads`` (topic, partition, high_watermark) for a
    source whose reports know the end of the micro-batch only.
    """
    reports = spark.createDataFrame([(p,) for p in progress_json], "report string")
    parsed = reports.select(
        F.get_json_object("report", "$.batchId").cast("bigint").alias("seq"),
        F.explode(F.from_json(F.get_json_object("report", "$.sources"), "array<map<string,string>>")).alias("s"),
    )
    offsets = parsed.select(
        "seq",
        *[F.from_json(F.col("s")[n], _OFFSETS).alias(n) for n in ("startOffset", "endOffset", "latestOffset")],
    ).filter("endOffset IS NOT NULL")
    by_topic = offsets.select("*", F.explode("endOffset").alias("topic", "ends"))
    rows = by_topic.select(
        "seq",
        "topic",
        F.coalesce(F.try_element_at("latestOffset", F.col("topic")), F.col("ends")).alias("heads"),
        F.try_element_at("startOffset", F.col("topic")).alias("starts"),
        F.explode("ends").alias("partition", "next"),
    )
    start = F.try_element_at("starts", F.col("partition"))
    empty = start.isNotNull() & (start == F.col("next")) | (F.col("next") <= 0)
    found = rows.select(
        "topic",
        F.col("partition").cast("int").alias("partition"),
        "seq",
        F.coalesce(F.try_element_at("heads", F.col("partition")), F.col("next")).alias("high_watermark"),
        F.when(empty, F.lit(-1)).otherwise(F.col("next") - 1).cast("bigint").alias("last_offset"),
    )
    if heads is None:
        return found
    known = found.drop("high_watermark").join(heads, ["topic", "partition"], "left")
    return known.select("topic", "partition", "seq", F.coalesce("high_watermark", F.col("last_offset") + 1).alias("high_watermark"), "last_offset")


class LagRecorder(StreamingQueryListener):
    """Keeps the position and the head of every partition of a query in a table, progress by progress.

    ``heads`` gives (topic, partition, high_watermark) now, for sources whose
    reports lack it. A query's table is two slots that are written in turn, so a
    reader always finds a whole one and the number of files stays as it is. A
    restart of the query goes on from its table. Register it with
    ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, heads: Callable[[], DataFrame] | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.heads = heads
        self.held: dict[str, list] = {}
        self.writes: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.held[str(event.id)] = [tuple(r) for r in _newest(_slots(self.spark, f"{self.path}/query={event.id}")).collect()]

    def onQueryProgress(self, event) -> None:
        query = str(event.progress.id)
        seen = observations(self.spark, [event.progress.json], self.heads() if self.heads else None)
        before = self.spark.createDataFrame(self.held.get(query, []), _STATE)
        self.held[query] = [tuple(r) for r in _newest(before.unionByName(seen)).collect()]  # a row per partition
        slot = self.writes[query] = 1 - self.writes.get(query, 1)
        rows = self.spark.createDataFrame(self.held[query], _STATE).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/query={query}/slot={slot}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _newest(rows: DataFrame) -> DataFrame:
    """The newest head and the last position of each partition; -1 where nothing was read yet."""
    read = F.col("last_offset") >= 0
    newest = rows.groupBy("topic", "partition").agg(
        F.max("seq").alias("newest"),
        F.max_by("high_watermark", "seq").alias("high_watermark"),
        F.max_by("last_offset", F.when(read, F.col("seq"))).alias("last_offset"),
    )
    return newest.select("topic", "partition", F.col("newest").alias("seq"), "high_watermark", F.coalesce("last_offset", F.lit(-1)).alias("last_offset"))


def _slots(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_STATE).parquet(f"{path}/slot=*")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)


def recorded(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """What ``LagRecorder`` holds of a query, as observations for ``partition_lag``; of a query that is unknown, none."""
    return _newest(_slots(spark, f"{path.rstrip('/')}/query={query_id}"))
