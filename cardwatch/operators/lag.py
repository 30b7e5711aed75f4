"""Consumer lag from fetch observations (partition, seq, high_watermark, last_offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_lag(observations: DataFrame) -> DataFrame:
    """Newest lag per partition.

    An empty fetch (offset below zero) keeps the last position; a partition
    that was never read is absent. Only the newest watermark and position
    count, so this is a plain aggregate with map-side combine and no ordered
    pass over a partition's history.
    """
    read = F.col("last_offset") >= 0
    newest = observations.groupBy("partition").agg(
        F.max_by("high_watermark", "seq").alias("_head"),
        F.max_by("last_offset", F.when(read, F.col("seq"))).alias("_position"),
        F.count_if(read).alias("_reads"),
    )
    behind = F.col("_head") - F.col("_position") - 1
    return newest.filter("_reads > 0").select(
        "partition", F.greatest(behind, F.lit(0)).cast("bigint").alias("lag")
    )


def lag_total(lags: DataFrame) -> DataFrame:
    return lags.agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("bigint").alias("lag_total"))
