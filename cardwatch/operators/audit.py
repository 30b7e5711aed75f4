"""Delivery, loss and load accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_run(verdicts: DataFrame, run_id: str) -> DataFrame:
    """Verdicts whose id starts with the run id."""
    return verdicts.filter(F.col("tx_id").startswith(run_id))


def missing_verdicts(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Expected ids that have no verdict."""
    ids = expected.select("tx_id").distinct()
    return ids.join(verdicts.select("tx_id").distinct(), "tx_id", "left_anti")


def delivery_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("tx_id").agg(F.count("*").alias("n"))


def delivery_audit(verdicts: DataFrame) -> DataFrame:
    """Verdicts delivered, ids seen, and ids seen more than once."""
    return delivery_counts(verdicts).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("delivered"),
        F.count("*").alias("distinct_ids"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("duplicated_ids"),
    )


def window_loss_audit(verdicts: DataFrame, flag: str, card: str = "card_hash") -> DataFrame:
    """Cards that show ``flag`` at least once (kept) and cards that never do (lost)."""
    per_card = verdicts.groupBy(card).agg(F.bool_or(F.array_contains("flags", flag)).alias("warm"))
    return per_card.agg(
        F.count_if(~F.col("warm")).cast("bigint").alias("lost"),
        F.count_if(F.col("warm")).cast("bigint").alias("kept"),
    )


def ingest_accounting(sends: DataFrame, elapsed_s, requested_rate: int = 0, late_failures: int = 0) -> DataFrame:
    """Totals over send results (offered, shed, error).

    A send that errors fails whole; a send that sheds keeps the rest. The rate
    counts only what was kept. ``late_failures`` are errors reported after the
    send returned. The run misses its target below 95 % of the requested rate.
    """
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    zero = F.lit(0).cast("bigint")

    def total(value):
        return F.coalesce(F.sum(value), zero).cast("bigint")

    totals = sends.agg(
        total(F.when(~failed, F.col("offered") - F.col("shed"))).alias("accepted"),
        (total(F.when(failed, F.col("offered"))) + F.lit(late_failures)).alias("failed"),
        total(F.when(~failed, F.col("shed"))).alias("shed"),
    )
    seconds = elapsed_s if not isinstance(elapsed_s, (int, float)) else F.lit(float(elapsed_s))
    achieved = F.col("accepted") / seconds
    kept_or_shed = F.col("accepted") + F.col("shed")
    return totals.select(
        "accepted",
        "failed",
        "shed",
        achieved.alias("achieved_rate"),
        F.when(F.col("shed") > 0, F.col("shed") / kept_or_shed * 100).otherwise(F.lit(0.0)).alias("shed_pct"),
        (
            F.lit(requested_rate > 0) & (achieved < F.lit(float(requested_rate)) * 0.95)
        ).alias("missed_target"),
    )
