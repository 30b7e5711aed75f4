"""Reading transactions: topic records, text files and JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch import schemas
from cardwatch.functions.columns import to_millis
from cardwatch.functions.decode import decode_bodies, decode_records
from cardwatch.session import configure

RECORD_COLUMNS = schemas.RAW_RECORD.fieldNames()


def kafka_records(
    spark: SparkSession,
    servers: str,
    topic: str = K.TX_TOPIC,
    max_offsets_per_trigger: int = 5_000_000,
    **options: str,
) -> DataFrame:
    """Records of a topic as a stream. Needs the Kafka connector on the classpath.

    The rate cap bounds a micro-batch, and with it the rows that one key can
    bring to a task at a time.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
        .option("kafka.fetch.max.bytes", str(16 << 20))
    )
    return reader.options(**options).load().select(*RECORD_COLUMNS)


def file_records(
    spark: SparkSession, path: str, max_files_per_trigger: int = 100, streaming: bool = True
) -> DataFrame:
    """Parquet files in the record shape, as a stream or a batch."""
    if not streaming:
        return spark.read.schema(schemas.RAW_RECORD).parquet(path)
    return (
        spark.readStream.schema(schemas.RAW_RECORD)
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
        .parquet(path)
    )


def spread(raw: DataFrame) -> DataFrame:
    """Records dealt to as many tasks as a shuffle has, however few files or partitions hold them: decoding costs far more than that."""
    return raw.repartition("partition", "offset")


def decode(raw: DataFrame) -> DataFrame:
    configure(raw.sparkSession)
    return decode_records(raw)


def good_transactions(decoded: DataFrame) -> DataFrame:
    """Typed transactions with ``ts_ms``; the record position is the tie order."""
    position = [c for c in ("partition", "offset") if c in decoded.columns]
    rows = decoded.filter("cause IS NULL").select("tx.*", *position)
    rows = rows.withColumn("ts_ms", to_millis(F.col("timestamp")))
    if position:
        rows = rows.withColumn("seq", F.struct(*position)).drop(*position)
    return rows


def dead_letter_struct(key: Column, value: Column, offset: Column) -> Column:
    """The record as it came, with where it came from in the headers."""
    headers = [
        ("cause", F.col("cause")),
        ("origin-topic", F.col("topic")),
        ("origin-partition", F.col("partition").cast("string")),
        ("origin-offset", offset.cast("string")),
    ]
    listed = [F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in headers]
    return F.struct(key.alias("key"), value.cast("binary").alias("value"), F.array(*listed).alias("headers"))


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Undecodable records."""
    record = dead_letter_struct(F.col("key"), F.col("value"), F.col("offset"))
    return decoded.filter("cause IS NOT NULL").select(record.alias("_d")).select("_d.*")


def body_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and whole text (one request body each)."""
    configure(spark)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("body"), "value")


def body_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000, packed: bool = False) -> DataFrame:
    """The same as a stream: a file is one body, read whole, once it is there.

    With ``packed`` a file is a Parquet table of many bodies (body, value).
    The driver lists every file of a stream, a few kilobytes each, so senders
    of many small bodies should write tables of them.
    """
    configure(spark)
    if packed:
        reader = spark.readStream.schema("body string, value string")
        return reader.option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(path)
    reader = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select(F.input_file_name().alias("body"), "value")


def read_bodies(bodies: DataFrame, ingest_time: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Transactions of the good bodies, and the rejected bodies with their cause."""
    configure(bodies.sparkSession)
    now = F.current_timestamp() if ingest_time is None else ingest_time
    checked = decode_bodies(bodies, now)
    others = [c for c in bodies.columns if c != "value"]
    good = checked.filter("cause IS NULL").select(*others, F.posexplode("txs").alias("pos", "tx"))
    good = good.select(*others, "pos", "tx.*").withColumn("ts_ms", to_millis(F.col("timestamp")))
    bad = checked.filter("cause IS NOT NULL").select(*bodies.columns, "cause")
    return good, bad
