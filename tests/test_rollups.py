import pytest
from helpers import verdict, verdicts
from pyspark.sql import functions as F

from cardwatch.operators import audit, feed, histogram, lag, metrics, rollups, timeline
from cardwatch.streaming.progress import observations


def us(spark, values):
    return spark.createDataFrame([(v,) for v in values], "us bigint")


def test_buckets_are_cumulative(spark):
    hist = histogram.histogram(us(spark, [1, 7, 40, 300, 9_000_000]), "us").collect()
    by = {r.le: r for r in hist}
    assert (by[1].cum_count, by[10].cum_count, by[5000].cum_count, by[None].cum_count) == (1, 2, 4, 5)
    assert (by[None]["sum"], by[None]["count"], len(hist)) == (9_000_348, 5, 16)


@pytest.mark.parametrize(
    "values,want",
    [
        ([3] * 98 + [9000] * 2, {0.5: 5, 0.99: 10_000}),
        ([3_000_000], {0.99: -1}),
        ([], {0.99: 0}),
        ([60] * 99 + [9000], {0.99: 100, 0.5: 100}),
        ([60], {0.0: 1}),
    ],
)
def test_quantiles(spark, values, want):
    out = histogram.quantiles(histogram.histogram(us(spark, values), "us"), list(want)).collect()
    assert {r.q: r.bound for r in out} == want


def test_lag(spark):
    rows = [(0, 1, 100, 99), (0, 2, 100, -1), (1, 1, 100, 89), (2, 1, 50, 60), (7, 1, 500, -1), (8, 1, 9, -1), (8, 2, 20, 9)]
    obs = spark.createDataFrame(rows, "partition int, seq bigint, high_watermark bigint, last_offset bigint")
    lags = lag.partition_lag(obs)
    assert {r.partition: r.lag for r in lags.collect()} == {0: 0, 1: 10, 2: 0, 8: 10}
    assert lag.lag_total(lags).first()[0] == 20
    assert lag.lag_total(lags.filter("partition > 90")).first()[0] == 0


def test_lag_from_progress(spark):
    report = (
        '{"batchId": %d, "sources": [{"startOffset": {"tx": {"0": %d, "1": 5}}, '
        '"endOffset": {"tx": {"0": %d, "1": 5}}, "latestOffset": {"tx": {"0": 100, "1": 9}}}]}'
    )
    obs = observations(spark, [report % (0, 0, 50), report % (1, 50, 90)])
    assert sorted(map(tuple, obs.collect())) == [("tx", 0, 0, 100, 49), ("tx", 0, 1, 100, 89), ("tx", 1, 0, 9, -1), ("tx", 1, 1, 9, -1)]
    assert [tuple(r) for r in lag.partition_lag(obs).collect()] == [(0, 10)]


def _metrics(spark, lags=None):
    rows = [
        verdict("a", 0, 1),
        verdict("b", 45, 2, flags=["geo_mismatch", "amount_high"]),
        verdict("c", 75, 3, flags=['we"ird\\\n']),
    ]
    df = verdicts(spark, rows)
    rate = spark.createDataFrame([(7,)], "rate bigint")
    hist = histogram.histogram(us(spark, [1, 2_000_000]), "us")
    return metrics.metric_rows(rollups.decision_counts(df), rollups.rule_fires(df), hist, rate, 4, lags).collect()


def test_metric_rows(spark):
    rows = _metrics(spark)
    values = {(r.metric, r.label): r.value for r in rows}
    assert values[("transactions_scored_total", "")] == 3
    assert values[("decisions_total", '{decision="decline"}')] == 1
    assert values[("submissions_rejected_total", "")] == 4
    assert values[("rule_fires_total", '{rule="we\\"ird\\\\\\n"}')] == 1
    assert values[("scoring_duration_microseconds_bucket", '{le="+Inf"}')] == 2
    assert values[("scoring_duration_microseconds_count", "")] == 2
    rules = [r.label for r in rows if r.metric == "rule_fires_total"]
    assert rules == sorted(rules)
    assert not any("lag" in r.metric for r in rows)


def test_metric_rows_with_lag(spark):
    lags = spark.createDataFrame([(10, 5), (2, 120), (0, 0)], "partition int, lag bigint")
    rows = [(r.label, r.value) for r in _metrics(spark, lags) if "lag" in r.metric]
    assert rows == [('{partition="0"}', 0), ('{partition="2"}', 120), ('{partition="10"}', 5), ("", 125)]


def test_metric_rows_of_one_pass_are_the_same(spark):
    rows = [
        verdict("a", 0, 61_000, latency_us=1),
        verdict("b", 45, 62_500, flags=["geo_mismatch", "amount_high"], latency_us=2_000_000),
        verdict("c", 75, 62_900, flags=['we"ird\\\n', "geo_mismatch"], latency_us=None),
    ]
    lags = spark.createDataFrame([(10, 5), (2, 120)], "partition int, lag bigint")
    for df in (verdicts(spark, rows), verdicts(spark, rows).filter("score > 99")):
        hist = histogram.histogram(df, "latency_us")
        rate = timeline.rate_history(timeline.throughput(df.withColumn("ts_ms", F.col("at"))), keep=1).select(F.col("n").alias("rate"))
        want = metrics.metric_rows(rollups.decision_counts(df), rollups.rule_fires(df), hist, rate, 4, lags).collect()
        one = metrics.scored_metric_rows(df, F.col("latency_us"), F.col("at"), 4, lags)
        assert one.collect() == want
        plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[tx_id") <= 1


def test_empty_rates(spark):
    none = verdicts(spark, [verdict("a", 0, 1)]).filter("score > 5")
    assert rollups.flagged_rate(none).first().flagged_rate == 0.0
    assert {r.pct for r in rollups.decision_share(rollups.decision_counts(none)).collect()} == {0.0}
    fires = rollups.rule_fires_map(rollups.rule_fires(none)).first()[0]
    assert fires == {}


def test_totals_equal_the_separate_counters(spark):
    df = verdicts(spark, [verdict("a", 0, 1), verdict("b", 45, 2, flags=["x"]), verdict("c", 45, 2, flags=["x", "y"])])
    totals = rollups.totals(df)
    assert rollups.counts_of(totals).first().asDict() == rollups.decision_counts(df).first().asDict()
    assert sorted(rollups.fires_of(totals).collect()) == sorted(rollups.rule_fires(df).collect())


def test_series_over_days(spark):
    day = timeline.DAY_S
    seconds = [day - 2, day - 2, day, 2 * day + 1]
    rows = spark.createDataFrame([(s * 1000 + 5,) for s in seconds], "ts_ms bigint")
    series = timeline.throughput(rows)
    got = {r.second: r.n for r in series.collect()}
    assert len(got) == day + 4 and sum(got.values()) == 4 and got[day - 2] == 2 and got[day - 1] == 0
    snaps = timeline.running_total(series)
    deltas = timeline.rate_delta(snaps).collect()
    assert {r.second: r.rate for r in deltas} == got
    assert max(r.processed for r in deltas) == 4
    last = timeline.rate_history(series, keep=3).collect()
    assert [r.second for r in last] == [2 * day - 1, 2 * day, 2 * day + 1]


def test_ingest_accounting(spark):
    ddl = "offered bigint, shed bigint, error string"
    kept = spark.createDataFrame([(10, 4, "")] * 3, ddl)
    row = audit.ingest_accounting(kept, 2.0, requested_rate=10).first()
    assert (row.accepted, row.shed, row.failed, row.achieved_rate) == (18, 12, 0, 9.0)
    assert row.shed_pct == 40.0 and row.missed_target
    bad = audit.ingest_accounting(spark.createDataFrame([(5, 0, "down")] * 2, ddl), 1.0, late_failures=3).first()
    assert (bad.accepted, bad.failed, bad.shed_pct, bad.missed_target) == (0, 13, 0.0, False)


def test_audits(spark):
    got = verdicts(spark, [verdict("r_1", 50, 1), verdict("r_1", 50, 1), verdict("r_2", 50, 2), verdict("s_1", 50, 3)])
    expected = spark.createDataFrame([("r_1",), ("r_2",), ("r_3",)], "tx_id string")
    assert [r.tx_id for r in audit.missing_verdicts(expected, got).collect()] == ["r_3"]
    assert tuple(audit.delivery_audit(audit.with_run(got, "r_")).first()) == (3, 2, 1)
    cards = spark.createDataFrame([("a", ["x"]), ("a", []), ("b", ["y"])], "card_hash string, flags array<string>")
    assert tuple(audit.window_loss_audit(cards, "x").first()) == (1, 1)


def test_feed(spark):
    rows = [verdict(f"t{i}", 50 if i % 10 == 0 else 0, i) for i in range(1, 300)]
    out = feed.recent(feed.feed_rows(verdicts(spark, rows)), 40).collect()
    want = [i for i in range(299, 0, -1) if i % 10 == 0 or i % 97 == 0][:40]
    assert [r.at for r in out] == want


def test_shares(spark):
    fires = spark.createDataFrame([("b", 4), ("a", 4), ("c", 1)], "rule string, fires bigint")
    assert [tuple(r) for r in rollups.rule_share_of_max(fires).collect()] == [("a", 4, 1.0), ("b", 4, 1.0), ("c", 1, 0.25)]
    assert [r.rule for r in rollups.top_rules(fires).collect()] == ["a", "b", "c"]
