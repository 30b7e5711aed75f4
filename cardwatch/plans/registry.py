"""Named queries: (spark, sf_dir) -> DataFrame, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch.functions.columns import flag_text, is_valid_resolution
from cardwatch.functions.rules import AMOUNT, CARD_VELOCITY, DEFAULT_RULES, GEO, IP_FANOUT, MCC, Rule
from cardwatch.operators import audit, cases, feed, histogram, lag, lookups, metrics, rollups, timeline
from cardwatch.operators.scoring import flagged, score, verdicts
from cardwatch.operators.velocity import CARD, IP, with_velocity
from cardwatch.plans import fixture as X
from cardwatch.plans import streams
from cardwatch.session import fresh_path, stage
from cardwatch.sources import records
from cardwatch.sources.sinks import transaction_messages, verdict_messages, write_keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return keep


# ---- rules and scores --------------------------------------------------------


@query("P1_rule_amount")
def rule_amount(spark, d):
    tx = X.transactions(spark, d)
    return tx.select("id", AMOUNT.points().alias("points"), AMOUNT.flag().alias("flag"))


@query("P2_rule_geo")
def rule_geo(spark, d):
    tx = lookups.with_issuer(X.transactions(spark, d))
    return tx.select("id", GEO.points().alias("points"), GEO.flag().alias("flag"))


@query("P3_rule_mcc")
def rule_mcc(spark, d):
    tx = X.transactions(spark, d)
    return tx.select("id", MCC.points().alias("points"), MCC.flag().alias("flag"))


@query("J1_bin_issuer_join")
def bin_issuer(spark, d):
    return lookups.with_issuer(X.transactions(spark, d)).select("id", "card_bin", "issuer")


@query("J2_mcc_exists")
def mcc_exists(spark, d):
    return lookups.in_high_risk_mcc(X.transactions(spark, d)).select("id", "mcc")


@query("W1_card_velocity")
def card_velocity(spark, d):
    return with_velocity(X.transactions(spark, d), (CARD,)).select("id", "card_n")


@query("W2_ip_fanout")
def ip_fanout(spark, d):
    return with_velocity(X.transactions(spark, d), (IP,)).select("id", "ip_n")


@query("P4_P5_velocity_points")
def velocity_points(spark, d):
    tx = with_velocity(X.transactions(spark, d))
    return tx.select(
        "id",
        CARD_VELOCITY.points().alias("card_points"),
        CARD_VELOCITY.flag().alias("card_flag"),
        IP_FANOUT.points().alias("ip_points"),
        IP_FANOUT.flag().alias("ip_flag"),
    )


@query("P6_score_flags")
def score_flags(spark, d):
    return X.scored_verdicts(spark, d).select("tx_id", "score", flag_text(F.col("flags")).alias("flags"))


@query("U1_own_rules")
def own_rules(spark, d):
    """The chain with one rule more, its points a Pandas UDF column as a model would give them."""

    @F.pandas_udf("int")
    def model(amount: pd.Series) -> pd.Series:
        return (amount >= 1000).astype("int32") * 7

    own = Rule("model", lambda: model(F.col("amount")), lambda: F.lit("model_high"))
    rows = verdicts(score(X.transactions(spark, d), (*DEFAULT_RULES, own)))
    return rows.select("tx_id", "score", "decision", F.array_contains("flags", "model_high").alias("modelled"))


@query("S6_keyed_files")
def keyed_files(spark, d):
    path = fresh_path(spark, "keyed")
    write_keyed(X.transactions(spark, d), path)
    return spark.read.parquet(path).select("id", "card_hash", "amount", "ts_ms")


@query("P7_decide")
def decisions(spark, d):
    return X.scored_verdicts(spark, d).select("tx_id", "decision")


@query("P8_verdicts")
def verdict_rows(spark, d):
    rows = X.scored_verdicts(spark, d)
    return rows.withColumn("flags", F.array_join("flags", ",")).drop("seq")


@query("P9_flagged")
def flagged_rows(spark, d):
    return flagged(X.scored_verdicts(spark, d)).select("tx_id", "score", "decision")


@query("P10_to_millis")
def to_millis(spark, d):
    return X.transactions(spark, d).select("id", "ts_ms")


@query("P11_valid_resolution")
def valid_resolution(spark, d):
    labels = X.resolutions(X.scored_verdicts(spark, d))
    return labels.select("id", "seq", is_valid_resolution(F.col("resolution")).alias("valid"))


@query("P13_run_prefix_filter")
def run_prefix(spark, d):
    return audit.with_run(X.scored_verdicts(spark, d), "tx_1").select("tx_id")


# ---- counters and histograms -------------------------------------------------


@query("A1_decision_counts")
def decision_counts(spark, d):
    return rollups.decision_counts(X.scored_verdicts(spark, d))


@query("A2_flagged_rate")
def flagged_rate(spark, d):
    return rollups.flagged_rate(X.scored_verdicts(spark, d))


@query("A3_rule_fires")
def rule_fires(spark, d):
    return rollups.rule_fires(X.scored_verdicts(spark, d))


@query("A4_latency_histogram")
def latency_histogram(spark, d):
    return histogram.histogram(X.latencies(spark, d), "us")


@query("W3_cumulative_buckets")
def cumulative_buckets(spark, d):
    us = X.latencies(spark, d)
    counts = us.groupBy(histogram.bucket_of(F.col("us")).alias("bucket")).agg(F.count("*").alias("n"))
    return histogram.cumulative_buckets(counts).select("bucket", "n", "cum_count")


@query("A5_histogram_quantile")
def histogram_quantile(spark, d):
    return histogram.quantiles(histogram.histogram(X.latencies(spark, d), "us"), [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])


@query("A6_throughput_1s")
def throughput(spark, d):
    return timeline.throughput(X.transactions(spark, d))


@query("W5_rate_delta")
def rate_delta(spark, d):
    series = stage(timeline.throughput(X.transactions(spark, d)), "series")
    snapshots = timeline.running_total(series)
    return timeline.rate_delta(snapshots).select("second", "processed", "rate")


@query("W8_rate_history")
def rate_history(spark, d):
    return timeline.rate_history(timeline.throughput(X.transactions(spark, d)))


@query("A9_decision_share")
def decision_share(spark, d):
    return rollups.decision_share(rollups.decision_counts(X.scored_verdicts(spark, d)))


@query("A10_rule_share_of_max")
def rule_share(spark, d):
    return rollups.rule_share_of_max(rollups.rule_fires(X.scored_verdicts(spark, d)))


@query("L4_top_rules")
def top_rules(spark, d):
    return rollups.top_rules(rollups.rule_fires(X.scored_verdicts(spark, d)))


@query("S9_metrics_rows")
def metric_rows(spark, d):
    scored = score(X.transactions(spark, d))
    rows = verdicts(scored, latency_us=(F.col("amount") * 100).cast("bigint"))
    return metrics.scored_metric_rows(rows, F.col("latency_us"), F.col("at"), lags=lag.partition_lag(X.lag_observations(spark, d)))


# ---- cases -------------------------------------------------------------------


def _case_rows(spark, d) -> DataFrame:
    verdicts = X.hot_verdicts(spark, d)
    return cases.resolve_cases(cases.open_cases(verdicts), X.resolutions(verdicts))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("id", "score", "status", "resolution", "opened_at", "resolved_at")


@query("W6_first_verdict_wins")
def first_verdict(spark, d):
    sent = X.deliveries(X.scored_verdicts(spark, d)).withColumn("at", F.col("at") + F.col("again") * 5)
    return cases.first_verdict_wins(sent).select("tx_id", "at", "score")


@query("J3_open_new_cases")
def open_new_cases(spark, d):
    verdicts = X.hot_verdicts(spark, d)
    known = cases.open_cases(verdicts.filter(F.col("seq") % 2 == 0)).select("id")
    return cases.open_cases(verdicts, known).select("id", "score", "opened_at")


@query("C1_open_cases")
def open_cases(spark, d):
    return _flat(cases.open_cases(X.scored_verdicts(spark, d)))


@query("J4_apply_resolutions")
def apply_resolutions(spark, d):
    verdicts = X.hot_verdicts(spark, d)
    done = cases.apply_resolutions(cases.open_cases(verdicts), X.resolutions(verdicts))
    return done.select("id", "resolution", "resolved_at")


@query("J4_rejected_resolutions")
def rejected_resolutions(spark, d):
    verdicts = X.hot_verdicts(spark, d)
    opened = cases.open_cases(verdicts.filter(F.col("seq") % 9 != 0))
    return cases.rejected_resolutions(opened, X.resolutions(verdicts)).select("id", "seq", "reason")


@query("C2_resolve_cases")
def resolve_cases(spark, d):
    return _flat(_case_rows(spark, d))


@query("A8_case_counts")
def case_counts(spark, d):
    return cases.case_counts(_case_rows(spark, d))


@query("C3_count_cases")
def count_cases(spark, d):
    return cases.case_counts(_case_rows(spark, d))


@query("P12_case_status_filter")
def case_status(spark, d):
    status = cases.queue_status("anything else")
    return _flat(_case_rows(spark, d).filter(F.col("status") == status))


@query("L1_review_queue")
def review_queue(spark, d):
    return _flat(cases.review_queue(_case_rows(spark, d)))


@query("L2_resolved_history")
def resolved_history(spark, d):
    return _flat(cases.list_cases(_case_rows(spark, d), K.RESOLVED))


@query("L5_queue_cap")
def queue_cap(spark, d):
    return _flat(cases.newest_open(_case_rows(spark, d)))


@query("L6_history_cap")
def history_cap(spark, d):
    return _flat(cases.newest_resolved(_case_rows(spark, d)))


@query("J5_queue_diff")
def queue_diff(spark, d):
    rows = _case_rows(spark, d)
    newer = cases.newest_open(rows)
    older = cases.newest_open(rows.filter(F.col("opened_at") % 5 != 0))
    return cases.queue_diff(newer, older).agg(F.count("*").alias("new_cases"))


@query("C5_label_export")
def label_export(spark, d):
    rows = cases.label_export(_case_rows(spark, d))
    return rows.withColumn("flags", F.array_join("flags", ","))


@query("S8_case_table")
def case_table(spark, d):
    return _flat(streams.case_table(spark, d))


@query("S8_labels_beside_stream")
def labels_beside_stream(spark, d):
    return _flat(streams.labels_beside_stream(spark, d))


# ---- feed, audits, lag -------------------------------------------------------


@query("W7_approval_sample")
def approval_sample(spark, d):
    return feed.approval_sample(X.scored_verdicts(spark, d)).select("tx_id", "processed_no")


@query("W7_approval_sample_by_id")
def approval_sample_by_id(spark, d):
    return feed.approval_sample_by_id(X.scored_verdicts(spark, d)).select("tx_id")


@query("L3_recent_feed")
def recent_feed(spark, d):
    rows = feed.newest_feed(X.scored_verdicts(spark, d))
    return rows.select("tx_id", "score", "decision", "at", flag_text(F.col("flags")).alias("flags"))


@query("J6_missing_verdicts")
def missing_verdicts(spark, d):
    verdicts = X.hot_verdicts(spark, d)
    return audit.missing_verdicts(verdicts, X.deliveries(verdicts))


@query("A12_delivery_audit")
def delivery_audit(spark, d):
    return audit.delivery_audit(X.deliveries(X.scored_verdicts(spark, d)))


@query("A13_window_loss_audit")
def window_loss(spark, d):
    scored = X.scored(spark, d)
    return audit.window_loss_audit(scored, "card_velocity_extreme")


@query("A11_ingest_accounting")
def ingest_accounting(spark, d):
    return audit.ingest_accounting(X.send_results(spark, d), 10.0, requested_rate=1_000_000)


@query("W4_partition_lag")
def partition_lag(spark, d):
    return lag.partition_lag(X.lag_observations(spark, d))


@query("A7_lag_total")
def lag_total(spark, d):
    return lag.lag_total(lag.partition_lag(X.lag_observations(spark, d)))


# ---- records in and out ------------------------------------------------------


@query("S3_decode_tx")
def decode_tx(spark, d):
    good = records.good_transactions(records.decode(X.raw_records(spark, d)))
    return good.select(
        "id", "card_bin", "card_hash", "amount", "currency", "country", "ip", "merchant_id", "mcc", "ts_ms"
    )


@query("S4_dlq_split")
def dlq_split(spark, d):
    dead = records.dead_letters(records.decode(X.raw_records(spark, d)))
    header = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string")))
    return dead.select(F.col("key").cast("string").alias("key"), F.array_join(header, ";").alias("headers"), F.col("value").cast("string").alias("value"))


@query("S5_write_verdicts")
def write_verdicts(spark, d):
    sent = verdict_messages(flagged(X.scored_verdicts(spark, d)))
    back = sent.select("key", F.from_json("value", "tx_id string, score int, flags array<string>, at bigint").alias("v"))
    return back.select("key", "v.tx_id", "v.score", F.array_join("v.flags", ",").alias("flags"), "v.at")


@query("S6_write_tx_keyed")
def write_tx_keyed(spark, d):
    tx = X.transactions(spark, d).withColumn("timestamp", F.timestamp_millis("ts_ms"))
    sent = transaction_messages(tx)
    return sent.select("key", F.get_json_object("value", "$.id").alias("id"))


@query("S2_read_tx_batch")
def read_tx_batch(spark, d):
    return streams.read_bodies(spark, d)


# ---- streams -----------------------------------------------------------------


@query("T1_stream_velocity")
def stream_velocity(spark, d):
    return streams.velocity(spark, d)


@query("T2_state_expiry")
def state_expiry(spark, d):
    return streams.expiring_velocity(spark, d)


@query("T2_keys_left")
def keys_left(spark, d):
    return streams.keys_left(spark, d)


@query("T4_commit_after_score")
def commit_after_score(spark, d):
    return streams.commit_after_score(spark, d)


@query("T3_late_events")
def late_events(spark, d):
    return streams.late_velocity(spark, d)


@query("T5_verdict_dedupe")
def verdict_dedupe(spark, d):
    return streams.dedupe(spark, d)


@query("T6_state_survives_restart")
def state_survives_restart(spark, d):
    return streams.restart_loss(spark, d)


@query("T7_stream_throughput")
def stream_throughput(spark, d):
    return streams.throughput(spark, d)


@query("T8_stream_snapshot")
def stream_snapshot(spark, d):
    return streams.snapshot(spark, d)


@query("T9_stream_lag")
def stream_lag(spark, d):
    return streams.stream_lag(spark, d)


@query("S1_read_tx_stream")
def read_tx_stream(spark, d):
    return streams.read_log(spark, d)


@query("S2_ingest_bodies")
def ingest_bodies(spark, d):
    return streams.ingested_bodies(spark, d)


@query("S7_topics_once")
def topics_once(spark, d):
    return streams.topics_once(spark, d)


@query("S1_S7_scoring_job")
def scoring_job(spark, d):
    return streams.scored_job(spark, d)
