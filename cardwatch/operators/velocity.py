"""Exact sliding-window counts per key in event time.

The count of a row is the number of rows of its key with a time in
``[t - window, t]`` that come no later than the row in ``(ts_ms, seq)`` order.

There is one plan, whatever the sizes: time is cut into blocks of a few
windows, and the rows of a key meet block by block. The rows of a block's last
window are copied into the next one, where they count and are not returned. So
a group holds a key for a few windows and never for its lifetime. Within a
group one frame counts the rows so far, and one that ends just before the
window counts the expired ones; both advance once per row.

A key that brings a large share of all rows within one block is taken apart
further. Rows are counted by hash bucket of (key, block), which combines before
the shuffle to a fixed number of rows. In a bucket above the limit only the
rows of one millisecond and one run of ``seq`` meet: a tick. What came before a
tick is a number made from the counts of the ticks, and it travels as one more
row of the tick, so rows are exchanged once per rule in either case. Which way
a bucket takes changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch import constants as K

#: Windows in a block: a key's group spans so many, and one row in so many is copied.
BLOCK_WINDOWS = 4
#: Hash buckets of (key, block), and how many of ``seq`` make a run.
BUCKETS, SEQ_RUN = 1 << 17, 1 << 16
#: Rows that a bucket may hold in any case, and how many times the mean bucket.
HOT_ROWS, HOT_MEANS = 500_000, 4


@dataclass(frozen=True)
class WindowRule:
    key: str
    window_ms: int
    out: str


CARD = WindowRule("card_hash", K.CARD_WINDOW_MS, "card_n")
IP = WindowRule("ip", K.IP_WINDOW_MS, "ip_n")


def _spread(rows: DataFrame, rule: WindowRule, ts: str, block_windows: int) -> DataFrame:
    """Every row in its block, and those of a block's last window once more in the next."""
    span = rule.window_ms * block_windows
    block = F.floor(F.col(ts) / F.lit(span)).cast("bigint")
    reaches = F.pmod(F.col(ts), F.lit(span)) >= span - rule.window_ms
    own = F.struct(block.alias("block"), F.lit(False).alias("copy"))
    again = F.struct((block + 1).alias("block"), F.lit(True).alias("copy"))
    spread = rows.withColumn("_at", F.explode(F.when(reaches, F.array(own, again)).otherwise(F.array(own))))
    bucket = F.pmod(F.xxhash64(rule.key, "_at.block"), F.lit(BUCKETS)).cast("int")
    return spread.select(*rows.columns, F.col("_at.block").alias("_block"), F.col("_at.copy").alias("_copy"), bucket.alias("_bucket"))


def hot_buckets(spread: DataFrame, limit: int) -> DataFrame:
    """Buckets with over ``limit`` rows and ``HOT_MEANS`` times the mean, so at most one in ``HOT_MEANS`` of all."""
    counts = spread.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # One row per bucket, so this window stays small.
    total = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return total.filter((F.col("_n") > limit) & (F.col("_n") * (BUCKETS // HOT_MEANS) > F.col("_all"))).select("_bucket", F.lit(True).alias("_hot"))


def _run(seq: str) -> Column:
    return F.floor(F.col(seq) / F.lit(SEQ_RUN)).cast("bigint")


def _ticks(spread: DataFrame, hot: DataFrame, rule: WindowRule, ts: str, seq: str) -> DataFrame:
    """(key, ts, _block, _run, _before) of the ticks in hot buckets: the rows in the window that come before the tick."""
    ticks = (
        spread.join(F.broadcast(hot), "_bucket")
        .groupBy(rule.key, "_block", "_copy", ts, _run(seq).alias("_run"))
        .agg(F.count("*").alias("_n"))
    )
    group = Window.partitionBy(rule.key, "_block")
    earlier = F.sum("_n").over(group.orderBy(ts, "_run").rowsBetween(Window.unboundedPreceding, -1))
    expired = F.sum("_n").over(group.orderBy(ts).rangeBetween(Window.unboundedPreceding, -(rule.window_ms + 1)))
    gone = F.when(F.col(ts).isNull(), F.lit(0)).otherwise(F.coalesce(expired, F.lit(0)))
    counted = ticks.withColumn("_before", F.coalesce(earlier, F.lit(0)) - gone)
    return counted.filter(~F.col("_copy")).select(rule.key, ts, "_block", "_run", "_before")


def count_in_window(
    rows: DataFrame,
    rule: WindowRule,
    ts: str = "ts_ms",
    seq: str = "seq",
    block_windows: int = BLOCK_WINDOWS,
    keys: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``rule.out``. A row without a time counts the rows of its key without a time so far.

    ``keys`` holds the key, ``ts`` and ``seq`` of the same rows where that is
    cheaper to read than ``rows``. Both are read more than once and have to
    give the same rows each time. Rows of one key, millisecond and ``seq`` meet
    in one group.
    """
    narrow = _spread((rows if keys is None else keys).select(rule.key, ts, seq), rule, ts, block_windows)
    hot = hot_buckets(narrow, hot_rows)
    spread = _spread(rows, rule, ts, block_windows).join(F.broadcast(hot), "_bucket", "left")
    is_hot = F.col("_hot").isNotNull()
    placed = spread.filter(~(F.col("_copy") & is_hot)).select(
        *rows.columns, "_block", "_copy",
        F.when(is_hot, F.col(ts)).alias("_tick"), F.when(is_hot, _run(seq)).alias("_run"),
        F.lit(True).alias("_row"), F.lit(None).cast("bigint").alias("_before"),
    )
    ticks = _ticks(narrow, hot, rule, ts, seq).select(
        *[F.col(f.name) if f.name in (rule.key, ts) else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema],
        "_block", F.lit(False).alias("_copy"), F.col(ts).alias("_tick"), "_run", F.lit(None).cast("boolean").alias("_row"), "_before",
    )
    group = Window.partitionBy(rule.key, "_block", "_tick", "_run")
    # The tick's own row has no seq, so it stands first or among rows that have none either.
    so_far = group.orderBy(ts, seq)
    expired = group.orderBy(ts).rangeBetween(Window.unboundedPreceding, -(rule.window_ms + 1))
    counted = (
        placed.unionByName(ticks)
        .withColumn("_so_far", F.count("_row").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_base", F.max("_before").over(so_far))
        .withColumn("_expired", F.count("_row").over(expired))
        .filter(F.col("_row") & ~F.col("_copy"))
    )
    gone = F.when(F.col(ts).isNull(), F.lit(0)).otherwise(F.col("_expired"))
    return counted.select(*rows.columns, (F.col("_so_far") + F.coalesce("_base", F.lit(0)) - gone).alias(rule.out))


def with_velocity(
    tx: DataFrame,
    rules: Sequence[WindowRule] = (CARD, IP),
    ts: str = "ts_ms",
    seq: str = "seq",
    block_windows: int = BLOCK_WINDOWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one exact window count per rule to every transaction; nothing runs until the result is read.

    ``seq`` breaks ties between equal times. Absent keys are the empty key, as
    one shared window. Duplicates are counted: remove them after scoring only.
    """
    rows = keys = tx.fillna("", [r.key for r in rules])
    for rule in rules:
        rows = count_in_window(rows, rule, ts, seq, block_windows, keys, hot_rows)
    return rows
