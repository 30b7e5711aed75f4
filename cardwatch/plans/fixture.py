"""Transactions derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch import schemas
from cardwatch.functions.columns import is_flagged
from cardwatch.operators.scoring import flagged, score, verdicts
from cardwatch.session import configure, stage

# Start of the event data and the factor that compresses time.
EPOCH_MS = 1704067200000
COMPRESS = 1440
BINS = ["411111", "455673", "510510", "520082", "530127", "601100", "356600", "627780", "506699", "999999"]
COUNTRIES = ["US", "GB", "DE", "SE", "SE", "US", "JP", "BR", "NG", "XX"]
MCCS = ["5942", "7832", "5541", "5651", "8062", "7995", "6051", "4829"]


def _pick(values: list[str], index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event, with ``ts_ms`` and ``seq`` (the event id)."""
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    base = events.select(
        "event_id",
        "user_id",
        "value",
        k.alias("k"),
        (F.lit(EPOCH_MS) + F.floor((ms - EPOCH_MS) / F.lit(COMPRESS))).cast("bigint").alias("ts_ms"),
    )
    user = F.col("user_id")
    event = F.col("event_id")
    return base.select(
        F.concat(F.lit("tx_"), event).alias("id"),
        _pick(BINS, user % 10).alias("card_bin"),
        F.concat(F.lit("tok_"), user).alias("card_hash"),
        (F.col("value") * F.lit(20.0)).alias("amount"),
        F.lit("SEK").alias("currency"),
        F.when(F.col("k") % 10 == 0, F.lit("RU")).otherwise(_pick(COUNTRIES, user % 10)).alias("country"),
        F.when(F.col("k") < 6, F.lit("10.9.9.9"))
        .otherwise(
            F.concat(F.lit("10."), user % 7, F.lit("."), user, F.lit("."), event % 2)
        )
        .alias("ip"),
        F.concat(F.lit("shop-"), event % 250).alias("merchant_id"),
        _pick(MCCS, F.col("k") % 8).alias("mcc"),
        "ts_ms",
        event.alias("seq"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(transactions(spark, sf_dir))


def scored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(scored(spark, sf_dir))


def hot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged verdicts as a table, scored once for queries that read them often."""
    return stage(flagged(scored_verdicts(spark, sf_dir)), "flagged")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long column that reaches every bucket."""
    return transactions(spark, sf_dir).select((F.col("amount") * 100).cast("bigint").alias("us"))


def resolutions(verdict_rows: DataFrame) -> DataFrame:
    """Labels for every third opened id (by event id), 90 s after the verdict.

    One in six of them is sent twice, and one in five carries no valid label.
    """
    picked = verdict_rows.filter(is_flagged()).filter(F.col("seq") % 3 == 0)
    label = F.when(F.col("score") >= K.DECLINE_SCORE, F.lit(K.CONFIRMED_FRAUD)).otherwise(F.lit(K.FALSE_POSITIVE))
    label = F.when(F.col("seq") % 5 == 0, F.lit("maybe")).otherwise(label)
    sends = F.when(F.col("seq") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return picked.select(
        F.col("tx_id").alias("id"), label.alias("resolution"), "at", "seq", F.explode(sends).alias("again")
    ).select(
        "id",
        "resolution",
        (F.col("at") + 90_000 + F.col("again") * 1000).alias("resolved_at"),
        F.lit("analyst").alias("resolved_by"),
        (F.col("seq") * 2 + F.col("again")).alias("seq"),
    )


def deliveries(verdict_rows: DataFrame) -> DataFrame:
    """Flagged verdicts as delivered: each eleventh is lost, each seventh comes twice."""
    sends = F.when(F.col("seq") % 11 == 0, F.array().cast("array<int>")).when(
        F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return verdict_rows.filter(is_flagged()).withColumn("again", F.explode(sends))


def lag_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch per event on six partitions; each seventh fetch is empty.

    The fetch number and the offset follow the event id, so no numbering pass
    is needed.
    """
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return events.select(
        (F.col("user_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") + F.col("user_id") % 50).alias("high_watermark"),
        F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.col("event_id") - 1).alias("last_offset"),
    )


def send_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One send per event: 100 offered, k of them shed, each 50th send in error."""
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    failed = F.col("event_id") % 50 == 0
    return events.select(
        (F.col("event_id") % 8).cast("int").alias("worker"),
        F.col("event_id").alias("seq"),
        F.lit(100).cast("bigint").alias("offered"),
        F.when(failed, F.lit(0))
        .otherwise(F.get_json_object("props", "$.k").cast("bigint") % 20)
        .cast("bigint")
        .alias("shed"),
        F.when(failed, F.lit("refused")).otherwise(F.lit("")).alias("error"),
    )


# Broken records of the decode test, built around a good JSON text.
BROKEN = [
    ("{not json", "invalid JSON"),
    ("", "empty record"),
    ("[<json>]", "not a JSON object"),
    ('{"id":5}', "id is not a string"),
    ("<json> x", "invalid JSON"),
    ("<json>,<json>", "more than one JSON document"),
    ('{"amount":"12"}', "amount is not a number"),
    ('{"amount":NaN}', "invalid JSON"),
    ('{"timestamp":"2024-01-01 00:00:00"}', "timestamp is not RFC 3339"),
]
BROKEN_EVERY = 40


def records_of(tx: DataFrame, partition: Column) -> DataFrame:
    """Transactions as topic records; the offset is twice the sequence number."""
    timed = tx.withColumn("timestamp", F.timestamp_millis("ts_ms"))
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp")
    fields = [text if n == "timestamp" else F.col(n) for n in schemas.TRANSACTION.fieldNames()]
    return timed.select(
        F.col("card_hash").cast("binary").alias("key"),
        F.to_json(F.struct(*fields)).alias("value"),
        F.lit(K.TX_TOPIC).alias("topic"),
        partition.cast("int").alias("partition"),
        (F.col("seq") * 2).alias("offset"),
        "timestamp",
    )


def raw_records(spark: SparkSession, sf_dir: str, broken: bool = True) -> DataFrame:
    """The transactions as topic records, and one broken record per 40 events."""
    user = F.substring("card_hash", 5, 20).cast("bigint")
    records = records_of(transactions(spark, sf_dir), user % 6)
    if not broken:
        return records
    event = F.col("offset") / 2
    kind = (F.floor(event / BROKEN_EVERY) % len(BROKEN)).cast("int")
    pattern = F.element_at(F.array(*[F.lit(t) for t, _ in BROKEN]), kind + 1)
    bad = records.filter(event % BROKEN_EVERY == 0).select(
        "key",
        F.replace(pattern, F.lit("<json>"), F.col("value")).alias("value"),
        "topic",
        "partition",
        (F.col("offset") + 1).alias("offset"),
        "timestamp",
    )
    return records.unionByName(bad)
