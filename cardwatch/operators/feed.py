"""The recent feed: flagged verdicts and a trickle of approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch.functions.columns import is_flagged
from cardwatch.operators.positions import with_position


def approval_sample(verdicts: DataFrame, every: int = K.APPROVAL_EVERY, order=("at", "seq")) -> DataFrame:
    """Approved verdicts whose number in processing order is a multiple of ``every``."""
    numbered = with_position(verdicts, list(order), out="processed_no", label="feed")
    return numbered.filter((F.col("decision") == K.APPROVE) & (F.col("processed_no") % every == 0))


def approval_sample_by_id(verdicts: DataFrame, every: int = K.APPROVAL_EVERY) -> DataFrame:
    """About one approval in ``every``, picked by a hash of the id.

    Row-local, so it needs no order and no shuffle; the stream uses it. It is
    not the same pick as ``approval_sample``.
    """
    bucket = F.conv(F.substring(F.md5(F.col("tx_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return verdicts.filter((F.col("decision") == K.APPROVE) & (bucket % every == 0))


def feed_rows(verdicts: DataFrame, every: int = K.APPROVAL_EVERY, exact: bool = True) -> DataFrame:
    picked = approval_sample(verdicts, every) if exact else approval_sample_by_id(verdicts, every)
    return verdicts.filter(is_flagged()).unionByName(picked.select(*verdicts.columns))


def recent(rows: DataFrame, keep: int = K.FEED_SIZE) -> DataFrame:
    """The newest ``keep`` rows, newest first."""
    tie = "seq" if "seq" in rows.columns else "tx_id"
    return rows.orderBy(F.desc("at"), F.desc(tie)).limit(keep)


def newest_feed(verdicts: DataFrame, keep: int = K.FEED_SIZE, every: int = K.APPROVAL_EVERY, order=("at", "seq")) -> DataFrame:
    """The newest ``keep`` rows of the exact feed, without numbering all verdicts.

    A row whose number is a multiple of ``every`` is in the feed, approved or
    flagged, so the newest ``keep * every`` verdicts hold ``keep`` rows of it.
    Only they are ordered, and are numbered down from the count of all.
    """
    newest = verdicts.orderBy(*[F.desc(c) for c in order]).limit(keep * every)
    back = F.row_number().over(Window.orderBy(*[F.desc(c) for c in order]))  # of keep * every rows at most
    total = verdicts.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    numbered = newest.withColumn("_back", back).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    number = F.col("_total") - F.col("_back") + 1
    return recent(numbered.filter(is_flagged() | (number % every == 0)).select(*verdicts.columns), keep)
