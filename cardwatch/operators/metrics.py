"""Counters, gauges and the histogram as one table of metric rows.

Every input has a bounded number of rows (one per decision, rule, bucket or
partition), so the ordered result is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch.functions.columns import label
from cardwatch.operators.histogram import bucket_of
from cardwatch.operators.lag import lag_total

DECISIONS = [(K.APPROVE, "approved"), (K.REVIEW, "reviewed"), (K.DECLINE, "declined")]


def _row(family: int, kind: str, value: Column, text=None, sort=None) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        F.lit(K.METRICS[family - 1]).alias("metric"),
        F.lit(kind).alias("type"),
        (F.lit("") if text is None else text).alias("label"),
        (F.lit(0) if sort is None else sort).cast("bigint").alias("sort"),
        value.cast("bigint").alias("value"),
    )


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def metric_rows(
    counts: DataFrame,
    fires: DataFrame,
    hist: DataFrame,
    rate_per_sec: DataFrame | None = None,
    rejected: int = 0,
    lags: DataFrame | None = None,
) -> DataFrame:
    """(metric, type, label, value) in a stable order.

    ``lags`` is None where nothing consumes a topic: the lag families are then
    absent, since a zero would read as a consumer that keeps up.
    """
    decisions = [
        _row(2, "counter", F.col(column), label("decision", F.lit(decision)), F.lit(i))
        for i, (decision, column) in enumerate(DECISIONS)
    ]
    bound = label("le", F.coalesce(F.col("le").cast("string"), F.lit("+Inf")))
    buckets = F.array(_row(5, "histogram", F.col("cum_count"), bound, F.col("bucket")))
    whole = F.array(
        _row(6, "histogram", F.col("sum")),
        _row(7, "histogram", F.col("count")),
    )
    parts = [
        _rows(
            counts,
            _row(1, "counter", F.col("processed")),
            *decisions,
            _row(3, "counter", F.lit(rejected)),
        ),
        _rows(fires, _row(4, "counter", F.col("fires"), label("rule", F.col("rule")))),
        # The overflow bucket also carries the totals.
        hist.select(F.inline(F.when(F.col("le").isNull(), F.concat(buckets, whole)).otherwise(buckets))),
    ]
    if rate_per_sec is not None:
        parts.append(_rows(rate_per_sec, _row(8, "gauge", F.col("rate"))))
    return _listed(parts, lags)


def _listed(parts: list[DataFrame], lags: DataFrame | None) -> DataFrame:
    if lags is not None:
        text = label("partition", F.col("partition").cast("string"))
        parts.append(_rows(lags, _row(9, "gauge", F.col("lag"), text, F.col("partition"))))
        parts.append(_rows(lag_total(lags), _row(10, "gauge", F.col("lag_total"))))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.orderBy("family", "sort", "label").select("metric", "type", "label", "value")


def scored_metric_rows(
    verdicts: DataFrame, latency: Column, at: Column, rejected: int = 0, lags: DataFrame | None = None
) -> DataFrame:
    """The same rows from one pass over scored rows (decision, flags and what the columns read).

    Decisions, rules, latency buckets and seconds are one exploded key space
    with map-side combine: a few keys and one per second. They meet in a single
    row, from which every family is read.
    """
    def mark(kind: str, name: Column, v: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(0) if v is None else v).cast("bigint").alias("v"))

    bucket = F.when(latency.isNotNull(), bucket_of(latency)).cast("string")
    second_of = F.floor(at / 1000).cast("string")
    marks = F.concat(
        F.array(mark("decision", F.col("decision")), mark("bucket", bucket, latency), mark("second", second_of)),
        F.transform("flags", lambda f: mark("rule", f)),
    )
    keys = verdicts.select(F.inline(marks)).filter("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    second = F.col("kind") == "second"
    entry = F.when(~second, F.struct(F.concat_ws("=", "kind", "name"), "n"))
    whole = keys.agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("n"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("sum"),
        F.max_by("n", F.when(second, F.col("name").cast("bigint"))).alias("rate"),
    )
    n = lambda kind, name: F.coalesce(F.try_element_at("n", F.lit(f"{kind}={name}")), F.lit(0))
    decisions = [_row(2, "counter", n("decision", d), label("decision", F.lit(d)), F.lit(i)) for i, (d, _) in enumerate(DECISIONS)]
    scored = reduce(Column.__add__, [n("decision", d) for d, _ in DECISIONS])
    upto, buckets = F.lit(0), []
    for i, bound in enumerate([*K.LATENCY_BOUNDS, "+Inf"]):
        upto = upto + n("bucket", i)
        buckets.append(_row(5, "histogram", upto, label("le", F.lit(str(bound))), F.lit(i)))
    rules = F.filter(F.map_entries("n"), lambda e: F.startswith(e["key"], F.lit("rule=")))
    fires = F.transform(rules, lambda e: _row(4, "counter", e["value"], label("rule", F.substring(e["key"], 6, 1000))))
    fixed = F.array(
        _row(1, "counter", scored),
        *decisions,
        _row(3, "counter", F.lit(rejected)),
        *buckets,
        _row(6, "histogram", F.col("sum")),
        _row(7, "histogram", upto),
    )
    rate = F.when(F.col("rate").isNotNull(), F.array(_row(8, "gauge", F.col("rate")))).otherwise(F.slice(F.array(_row(8, "gauge", F.lit(0))), 1, 0))
    return _listed([whole.select(F.inline(F.concat(fixed, fires, rate)))], lags)
