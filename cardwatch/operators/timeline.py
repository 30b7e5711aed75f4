"""Per-second series: counts, running totals, differences and the newest part.

Ordered operators cut time into days. Rows are ordered inside a day, and only
one row per day meets in the table that links the days, so no task sees the
whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch import constants as K

DAY_S = 86_400


def _day(column: str):
    return F.floor(F.col(column) / F.lit(DAY_S)).cast("bigint")


def seconds_spine(counts: DataFrame, second: str = "second") -> DataFrame:
    """Every second between the first and the last one present.

    Days are listed first and spread over tasks; each day then lists its own
    seconds, so the series is never one array.
    """
    bounds = counts.agg(F.min(second).alias("lo"), F.max(second).alias("hi")).filter("lo IS NOT NULL")
    days = bounds.select("lo", "hi", F.explode(F.sequence(_day("lo"), _day("hi"))).alias("day"))
    start = F.greatest(F.col("lo"), F.col("day") * DAY_S)
    end = F.least(F.col("hi"), F.col("day") * DAY_S + (DAY_S - 1))
    return days.repartition("day").select(F.explode(F.sequence(start, end)).alias(second))


def throughput(rows: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Rows per second, with zero for the seconds that saw none."""
    second = F.floor(F.col(ts) / F.lit(1000)).cast("bigint")
    counts = rows.groupBy(second.alias("second")).agg(F.count("*").alias("n"))
    return (
        seconds_spine(counts)
        .join(counts, "second", "left")
        .select("second", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def running_total(series: DataFrame, second: str = "second", n: str = "n", out: str = "processed") -> DataFrame:
    """Cumulative count at each second."""
    cut = series.withColumn("_day", _day(second))
    inside = Window.partitionBy("_day").orderBy(second).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_day").agg(F.sum(n).alias("_total"))
    base = totals.select("_day", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_base"))
    return (
        cut.withColumn("_in", F.sum(n).over(inside))
        .join(base, "_day")
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint"))
        .drop("_day", "_in", "_base")
    )


def rate_delta(snapshots: DataFrame, second: str = "second", total: str = "processed") -> DataFrame:
    """Growth of a counter since the snapshot before (0 before the first one)."""
    cut = snapshots.withColumn("_day", _day(second))
    inside = Window.partitionBy("_day").orderBy(second)
    last = cut.groupBy("_day").agg(F.max_by(total, second).alias("_last"))
    carried = last.select("_day", F.lag("_last", 1, 0).over(Window.orderBy("_day")).alias("_carried"))
    before = F.coalesce(F.lag(total, 1).over(inside), F.lit(None).cast("bigint"))
    return (
        cut.withColumn("_before", before)
        .join(carried, "_day")
        .withColumn("rate", F.col(total) - F.coalesce("_before", "_carried"))
        .drop("_day", "_before", "_carried")
    )


def rate_history(series: DataFrame, second: str = "second", keep: int = K.RATE_HISTORY) -> DataFrame:
    """The newest ``keep`` samples, oldest first."""
    return series.orderBy(F.desc(second)).limit(keep).orderBy(second)
