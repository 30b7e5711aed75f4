"""Counters over verdicts. Each is a partial + final hash aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch import constants as K


def _n(decision: str) -> Column:
    return F.count_if(F.col("decision") == decision).cast("bigint")


def decision_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("processed"),
        _n(K.APPROVE).alias("approved"),
        _n(K.REVIEW).alias("reviewed"),
        _n(K.DECLINE).alias("declined"),
    )


def with_flagged_rate(counts: DataFrame) -> DataFrame:
    rate = (F.col("reviewed") + F.col("declined")) / F.col("processed")
    return counts.withColumn("flagged_rate", F.when(F.col("processed") > 0, rate).otherwise(F.lit(0.0)))


def flagged_rate(verdicts: DataFrame) -> DataFrame:
    return with_flagged_rate(decision_counts(verdicts)).select("processed", "flagged_rate")


def rule_fires(verdicts: DataFrame) -> DataFrame:
    return (
        verdicts.select(F.explode("flags").alias("rule")).groupBy("rule").agg(F.count("*").alias("fires"))
    )


def totals(verdicts: DataFrame, extra: Column | None = None) -> DataFrame:
    """Decision counts and rule fires in one pass: (kind, name, n).

    ``extra`` is an array of further (kind, name) structs to count per row.
    """
    marks = F.concat(
        F.array(F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name"))),
        F.transform("flags", lambda f: F.struct(F.lit("rule").alias("kind"), f.alias("name"))),
        *([] if extra is None else [extra]),
    )
    return verdicts.select(F.inline(marks)).groupBy("kind", "name").agg(F.count("*").alias("n"))


def counts_of(total_rows: DataFrame) -> DataFrame:
    """The decision counts back from ``totals``."""

    def n(decision: str) -> Column:
        hit = (F.col("kind") == "decision") & (F.col("name") == decision)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint")

    counts = total_rows.agg(
        n(K.APPROVE).alias("approved"), n(K.REVIEW).alias("reviewed"), n(K.DECLINE).alias("declined")
    )
    return counts.withColumn("processed", F.col("approved") + F.col("reviewed") + F.col("declined"))


def fires_of(total_rows: DataFrame) -> DataFrame:
    return total_rows.filter(F.col("kind") == "rule").select(F.col("name").alias("rule"), F.col("n").alias("fires"))


def rule_fires_map(fires: DataFrame) -> DataFrame:
    """The same counters as one map, ordered by rule name (a row per flag)."""
    pairs = F.array_sort(F.collect_list(F.struct("rule", "fires")))
    return fires.agg(F.map_from_entries(pairs).alias("rule_fires"))


def _long(counts: DataFrame) -> DataFrame:
    return counts.unpivot(
        ["processed"], ["approved", "reviewed", "declined"], "counter", "n"
    ).withColumn(
        "decision",
        F.when(F.col("counter") == "approved", K.APPROVE)
        .when(F.col("counter") == "reviewed", K.REVIEW)
        .otherwise(K.DECLINE),
    )


def decision_share(counts: DataFrame) -> DataFrame:
    """Percent per decision; an empty run divides by one."""
    return _long(counts).select(
        "decision",
        "n",
        (F.col("n") / F.greatest("processed", F.lit(1)) * 100).alias("pct"),
    )


def rule_share_of_max(fires: DataFrame) -> DataFrame:
    """Fires relative to the busiest rule. The input has one row per flag."""
    top = F.greatest(F.max("fires").over(Window.partitionBy()), F.lit(1))
    return fires.select("rule", "fires", (F.col("fires") / top).alias("share")).orderBy(
        F.desc("fires"), "rule"
    )


def top_rules(fires: DataFrame) -> DataFrame:
    return fires.orderBy(F.desc("fires"), "rule")
