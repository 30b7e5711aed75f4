"""The review queue as tables: open, resolve, list, count, export.

The contract is the durable one: a transaction has one case for life.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch import schemas
from cardwatch.functions.columns import is_flagged, is_valid_resolution, queue_status

INVALID = "invalid_resolution"
NOT_OPEN = "not_found_or_already_resolved"


def first_per_id(rows: DataFrame, id_column: str, order: Column) -> DataFrame:
    """The earliest row per id, by aggregation.

    Each task keeps one candidate per id before the shuffle, so a run of
    copies of one id never meets in a task.
    """
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(id_column).alias("_id")).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def first_verdict_wins(verdicts: DataFrame, order=("at", "seq")) -> DataFrame:
    return first_per_id(verdicts, "tx_id", F.struct(*order))


def new_cases(first: DataFrame, opened_at: Column | None = None) -> DataFrame:
    return first.select(
        F.col("tx_id").alias("id"),
        F.struct(*schemas.VERDICT_FIELDS).alias("verdict"),
        F.col("score"),
        F.lit(K.OPEN).alias("status"),
        F.lit(None).cast("string").alias("resolution"),
        (F.col("at") if opened_at is None else opened_at).cast("bigint").alias("opened_at"),
        F.lit(None).cast("bigint").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by"),
    )


def open_cases(
    verdicts: DataFrame,
    known_ids: DataFrame | None = None,
    order=("at", "seq"),
    opened_at: Column | None = None,
) -> DataFrame:
    """New cases for flagged verdicts whose id has none yet."""
    first = first_verdict_wins(verdicts.filter(is_flagged()), order)
    if known_ids is not None:
        first = first.join(known_ids.select(F.col("id").alias("tx_id")), "tx_id", "left_anti")
    return new_cases(first, opened_at)


def first_resolutions(resolutions: DataFrame) -> DataFrame:
    """The first valid label per case id (id, resolution, resolved_at, resolved_by, seq)."""
    return first_per_id(resolutions.filter(is_valid_resolution(F.col("resolution"))), "id", F.struct("seq"))


def apply_resolutions(cases: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The cases that become resolved, in their new state."""
    labels = first_resolutions(resolutions).select(
        "id",
        F.col("resolution").alias("_resolution"),
        F.col("resolved_at").alias("_resolved_at"),
        F.col("resolved_by").alias("_resolved_by"),
    )
    pending = cases.filter(F.col("status") == K.OPEN)
    return pending.join(labels, "id").select(
        "id",
        "verdict",
        "score",
        F.lit(K.RESOLVED).alias("status"),
        F.col("_resolution").alias("resolution"),
        "opened_at",
        F.col("_resolved_at").alias("resolved_at"),
        F.col("_resolved_by").alias("resolved_by"),
    )


def rejected_resolutions(cases: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every resolution that changes nothing, with the reason."""
    pending = cases.filter(F.col("status") == K.OPEN).select("id")
    used = first_resolutions(resolutions).join(pending, "id", "left_semi").select("id", "seq")
    reason = F.when(is_valid_resolution(F.col("resolution")), F.lit(NOT_OPEN)).otherwise(F.lit(INVALID))
    return resolutions.join(used, ["id", "seq"], "left_anti").withColumn("reason", reason)


def resolve_cases(cases: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The whole case table after the labels are applied.

    Both sides hold one row per id, so the join is one to one.
    """
    labels = first_resolutions(resolutions).select(
        "id",
        F.col("resolution").alias("_resolution"),
        F.col("resolved_at").alias("_resolved_at"),
        F.col("resolved_by").alias("_resolved_by"),
    )
    hit = (F.col("status") == K.OPEN) & F.col("_resolution").isNotNull()

    def updated(name: str, new: Column) -> Column:
        return F.when(hit, new).otherwise(F.col(name)).alias(name)

    return cases.join(labels, "id", "left").select(
        "id",
        "verdict",
        "score",
        updated("status", F.lit(K.RESOLVED)),
        updated("resolution", F.col("_resolution")),
        "opened_at",
        updated("resolved_at", F.col("_resolved_at")),
        updated("resolved_by", F.col("_resolved_by")),
    )


def review_queue(cases: DataFrame, limit: int = K.QUEUE_LIMIT) -> DataFrame:
    """Worst first: score, then newest, then id."""
    return (
        cases.filter(F.col("status") == K.OPEN)
        .orderBy(F.desc("score"), F.desc("opened_at"), "id")
        .limit(limit)
    )


def resolved_history(cases: DataFrame, limit: int = K.QUEUE_LIMIT) -> DataFrame:
    """Newest resolutions first."""
    return cases.filter(F.col("status") == K.RESOLVED).orderBy(F.desc("resolved_at"), "id").limit(limit)


def list_cases(cases: DataFrame, status: str | None = None, limit: int = K.QUEUE_LIMIT) -> DataFrame:
    if queue_status(status) == K.RESOLVED:
        return resolved_history(cases, limit)
    return review_queue(cases, limit)


def newest_open(cases: DataFrame, cap: int = K.QUEUE_CAP) -> DataFrame:
    """The newest ``cap`` open cases."""
    return cases.filter(F.col("status") == K.OPEN).orderBy(F.desc("opened_at"), "id").limit(cap)


def newest_resolved(cases: DataFrame, cap: int = K.QUEUE_CAP) -> DataFrame:
    """The newest ``cap`` resolved cases, whatever the totals say."""
    return resolved_history(cases, cap)


def case_counts(cases: DataFrame) -> DataFrame:
    def n(test: Column, name: str) -> Column:
        return F.count_if(test).cast("bigint").alias(name)

    done = F.col("status") == K.RESOLVED
    return cases.agg(
        n(F.col("status") == K.OPEN, "open"),
        n(done & (F.col("resolution") == K.CONFIRMED_FRAUD), "confirmed_fraud"),
        n(done & (F.col("resolution") == K.FALSE_POSITIVE), "false_positive"),
    )


def queue_diff(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Cases in the newer queue snapshot that the older one lacks."""
    return newer.join(older.select("id"), "id", "left_anti")


def label_export(cases: DataFrame) -> DataFrame:
    """Labelled verdicts: the training set."""
    return cases.filter(F.col("status") == K.RESOLVED).select("resolution", "verdict.*")
