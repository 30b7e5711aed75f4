"""Global row numbers without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.session import stage

_PARTITION_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | row


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    out: str = "position",
    partitions: int | None = None,
    label: str = "positions",
) -> DataFrame:
    """Number all rows 1..N in the given order.

    Rows are range-partitioned and sorted, each partition numbers its own rows,
    and the partition counts (one row per partition) give the offsets. Equal
    rows are told apart by an extra column, so a run of identical copies can
    spread over any number of partitions. The sorted rows are written once,
    because the offsets and the rows must come from the same partitioning.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    order: list[str | Column] = [*order_by, "_tie"]
    spread = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    local = (
        spread.sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_at", _PARTITION_BITS).alias("_part"),
            F.col("_at").bitwiseAND((1 << _PARTITION_BITS) - 1).alias("_row"),
        )
    )
    rows = stage(local, label)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per range partition, so this window and broadcast stay small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_base") + F.col("_row") + 1).alias(out)
    )
