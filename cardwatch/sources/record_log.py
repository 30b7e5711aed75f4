"""Topics on files: partitions with offsets, readable as a batch and as a stream.

A log holds segments, files of consecutive records of one topic partition in
offset order, and an index with the offsets of each segment. A segment counts
once its index row exists, so a reader never sees half an append. The stream
reads through Spark's Python data source interface: its offsets are
``{topic: {partition: next offset}}``, each topic partition is one split of a
micro-batch, and ``maxOffsetsPerTrigger`` bounds a micro-batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardwatch import schemas

FORMAT = "record_log"
#: Rows of a segment at most.
SEGMENT_ROWS = 1_000_000
_INDEX = "topic string, partition int, first long, next long, rows long, file string"

Offsets = dict[str, dict[str, int]]


def append(records: DataFrame, path: str, segment_rows: int = SEGMENT_ROWS) -> None:
    """Add ``records`` (the columns of a raw record) to the log at ``path``.

    Offsets are given by the caller and rise from append to append in each
    topic partition; they may have gaps. A repeat of an append is a second one.
    """
    spark = records.sparkSession
    name = uuid.uuid4().hex
    own = f"{path.rstrip('/')}/segments/append={name}"
    (
        records.select(*schemas.RAW_RECORD.fieldNames())
        .repartition("topic", "partition")
        .sortWithinPartitions("topic", "partition", "offset")
        .write.option("maxRecordsPerFile", str(segment_rows))
        .partitionBy("topic", "partition")
        .parquet(own)
    )
    written = spark.read.schema(schemas.RAW_RECORD).parquet(own)
    index = written.groupBy("topic", "partition", F.input_file_name().alias("file")).agg(
        F.min("offset").alias("first"), (F.max("offset") + 1).alias("next"), F.count("*").alias("rows")
    )
    # One file, which appears at once: the append is there or it is not.
    index.select("topic", "partition", "first", "next", "rows", "file").repartition(1).write.parquet(f"{path.rstrip('/')}/index/{name}")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The index: one row per segment."""
    return spark.read.schema(_INDEX).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/index")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition, high_watermark) of the log now."""
    return segments(spark, path).groupBy("topic", "partition").agg(F.max("next").alias("high_watermark"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the log as a batch."""
    files = segments(spark, path).select("file").distinct()
    stored = spark.read.schema(schemas.RAW_RECORD).parquet(f"{path.rstrip('/')}/segments")
    return stored.withColumn("_file", F.input_file_name()).join(files, F.col("_file") == F.col("file"), "left_semi").select(*schemas.RAW_RECORD.fieldNames())


def stream(spark: SparkSession, path: str, position: str, max_offsets_per_trigger: int = 5_000_000) -> DataFrame:
    """Records of the log as a stream.

    ``position`` is a file of this stream's own, beside its checkpoint, in
    which the end of the newest planned micro-batch is kept.
    """
    spark.dataSource.register(RecordLogSource)
    reader = spark.readStream.format(FORMAT).option("path", path.rstrip("/")).option("position", position)
    return reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger)).load()


def admitted(at: Offsets, heads: Offsets, limit: int) -> Offsets:
    """Ends of the next micro-batch: what is new, or ``limit`` offsets shared out by how much each partition has, rounded up."""
    new = {(t, p): head - at.get(t, {}).get(p, 0) for t, own in heads.items() for p, head in own.items()}
    total = sum(new.values())
    out: Offsets = {}
    for (t, p), n in sorted(new.items()):
        share = n if total <= limit else -(-n * limit // total)
        out.setdefault(t, {})[p] = at.get(t, {}).get(p, 0) + share
    return out


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Split(InputPartition):
    topic: str
    partition: int
    start: int
    end: int
    files: list[str]


class RecordLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.position = options["position"]
        self.limit = int(options.get("maxoffsetspertrigger", options.get("maxOffsetsPerTrigger", 5_000_000)))
        self.planned: Offsets | None = None

    def _index(self) -> list[dict]:
        store, path = _filesystem(f"{self.path}/index")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return []
        names = ["topic", "partition", "first", "next", "file"]
        return ds.dataset(path, filesystem=store, format="parquet").to_table(columns=names).to_pylist()

    def _at(self) -> Offsets:
        """The end of the newest planned micro-batch. A repeated one is planned again before the next is asked for."""
        if self.planned is None:
            store, path = _filesystem(self.position)
            known = store.get_file_info(path).type == fs.FileType.File
            self.planned = json.loads(store.open_input_stream(path).read()) if known else {}
        return self.planned

    def _plan(self, end: Offsets) -> None:
        store, path = _filesystem(self.position)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{path}.new") as out:
            out.write(json.dumps(end).encode())
        store.move(f"{path}.new", path)
        self.planned = end

    def initialOffset(self) -> Offsets:
        return {}

    def latestOffset(self) -> Offsets:
        heads: Offsets = {}
        for row in self._index():
            own = heads.setdefault(row["topic"], {})
            own[str(row["partition"])] = max(row["next"], own.get(str(row["partition"]), 0))
        return admitted(self._at(), heads, self.limit)

    def partitions(self, start: Offsets, end: Offsets) -> list[Split]:
        self._plan(end)
        rows = self._index()
        out = []
        for topic, own in sorted(end.items()):
            for partition, last in sorted(own.items()):
                first = start.get(topic, {}).get(partition, 0)
                held = [r for r in rows if r["topic"] == topic and r["partition"] == int(partition) and r["first"] < last and r["next"] > first]
                if first < last and held:
                    out.append(Split(topic, int(partition), first, last, [r["file"] for r in sorted(held, key=lambda r: r["first"])]))
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field("offset") >= partition.start) & (ds.field("offset") < partition.end)
        for file in partition.files:
            store, path = _filesystem(file)
            columns = ["key", "value", "offset", "timestamp"]
            table = ds.dataset(path, filesystem=store, format="parquet", partitioning=None)
            for batch in table.to_batches(columns=columns, filter=wanted):
                if batch.num_rows:
                    key, value, offset, at = (batch.column(c) for c in columns)
                    topic = pa.repeat(pa.scalar(partition.topic), batch.num_rows)
                    number = pa.repeat(pa.scalar(partition.partition, pa.int32()), batch.num_rows)
                    yield pa.RecordBatch.from_arrays([key, value, topic, number, offset, at.cast(pa.timestamp("us", "UTC"))], schemas.RAW_RECORD.fieldNames())


class RecordLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return schemas.RAW_RECORD

    def streamReader(self, schema) -> RecordLogReader:
        return RecordLogReader(self.options)
