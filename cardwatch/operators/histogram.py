"""Fixed-bucket histograms and quantiles read back from the buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwatch import constants as K


def bucket_of(value: Column, bounds: Sequence[int] = tuple(K.LATENCY_BOUNDS)) -> Column:
    """Index of the first bound that is not below the value; len(bounds) = overflow."""
    index = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        index = F.when(value <= bounds[i], F.lit(i)).otherwise(index)
    return index.cast("int")


def _dense(spark: SparkSession, bounds: Sequence[int]) -> DataFrame:
    rows = [f"({i}, {b}L)" for i, b in enumerate(bounds)] + [f"({len(bounds)}, CAST(NULL AS BIGINT))"]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS b(bucket, le)")


def histogram(
    values: DataFrame, column: str, bounds: Sequence[int] = tuple(K.LATENCY_BOUNDS)
) -> DataFrame:
    """Cumulative counts: one row per bound plus the overflow row (``le`` null).

    Every row also carries the total ``sum`` and ``count``.
    """
    counted = (
        values.select(F.col(column).cast("bigint").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy(bucket_of(F.col("v"), bounds).alias("bucket"))
        .agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    )
    dense = _dense(values.sparkSession, bounds).join(counted, "bucket", "left")
    # At most len(bounds) + 1 rows reach these windows.
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    return dense.select(
        "bucket",
        "le",
        F.coalesce(F.sum("n").over(running), zero).alias("cum_count"),
        F.coalesce(F.sum("s").over(every), zero).alias("sum"),
        F.coalesce(F.sum("n").over(every), zero).alias("count"),
    )


def from_counts(counts: DataFrame, bounds: Sequence[int] = tuple(K.LATENCY_BOUNDS)) -> DataFrame:
    """Cumulative counts of a table of counts by bucket (bucket, n), several rows of a bucket being added up."""
    summed = counts.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    return _dense(counts.sparkSession, bounds).join(summed, "bucket", "left").select(
        "bucket", "le", F.coalesce(F.sum("n").over(running), zero).alias("cum_count"), F.coalesce(F.sum("n").over(Window.partitionBy()), zero).alias("count")
    )


def cumulative_buckets(counts: DataFrame, order: str = "bucket", n: str = "n") -> DataFrame:
    """Running total over an ordered bucket table (a row per bucket)."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cum_count", F.sum(n).over(running))


def quantiles(hist: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Upper bound of the first bucket whose cumulative count reaches q * N.

    -1 when that is the overflow bucket, 0 for an empty histogram. The bound is
    never interpolated.
    """
    picks = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    hit = F.when(F.col("cum_count") >= F.col("count") * F.col("q"), F.col("bucket"))
    first = hist.select("*", picks).withColumn("hit", hit)
    return first.groupBy("q").agg(
        F.max("count").alias("_count"),
        F.min_by("le", "hit").alias("_le"),
    ).select(
        "q",
        F.when(F.col("_count") == 0, F.lit(0))
        .otherwise(F.coalesce("_le", F.lit(K.QUANTILE_OVERFLOW)))
        .cast("bigint")
        .alias("bound"),
    )
