"""From transactions to verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.columns import is_flagged
from cardwatch.functions.rules import DEFAULT_RULES, Rule, apply_rules
from cardwatch.operators.lookups import with_issuer
from cardwatch.operators.velocity import with_velocity


def score_counted(
    counted: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, bins: DataFrame | None = None
) -> DataFrame:
    """Score rows that already carry ``card_n`` and ``ip_n``."""
    return apply_rules(with_issuer(counted, bins), rules)


def score(
    tx: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    bins: DataFrame | None = None,
    **velocity,
) -> DataFrame:
    """Score a batch of transactions (columns of the schema, ``ts_ms``, ``seq``)."""
    return score_counted(with_velocity(tx, **velocity), rules, bins)


def verdict_struct(latency_us: Column | None = None, at: Column | None = None) -> Column:
    """The verdict of a scored row. ``at`` defaults to the event time, for repeatable runs."""
    return F.struct(
        F.col("id").alias("tx_id"),
        "card_bin",
        "amount",
        "currency",
        "country",
        "score",
        "flags",
        "decision",
        (F.lit(0).cast("bigint") if latency_us is None else latency_us).alias("latency_us"),
        (F.col("ts_ms") if at is None else at).alias("at"),
    )


def verdicts(scored: DataFrame, latency_us: Column | None = None, at: Column | None = None) -> DataFrame:
    """The verdict rows; ``seq`` comes along where there is one."""
    extra = [c for c in ("seq",) if c in scored.columns]
    return scored.select(verdict_struct(latency_us, at).alias("_v"), *extra).select("_v.*", *extra)


def flagged(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.filter(is_flagged())

