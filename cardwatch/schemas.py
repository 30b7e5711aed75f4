"""Row types of the records that flow through the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("card_bin", T.StringType()),
        T.StructField("card_hash", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

TEXT_FIELDS = [f.name for f in TRANSACTION if isinstance(f.dataType, T.StringType)]

VERDICT = T.StructType(
    [
        T.StructField("tx_id", T.StringType()),
        T.StructField("card_bin", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("decision", T.StringType()),
        T.StructField("latency_us", T.LongType()),
        T.StructField("at", T.LongType()),
    ]
)

VERDICT_FIELDS = VERDICT.fieldNames()

CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("verdict", VERDICT),
        T.StructField("score", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("opened_at", T.LongType()),
        T.StructField("resolved_at", T.LongType()),
        T.StructField("resolved_by", T.StringType()),
    ]
)

RAW_RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
