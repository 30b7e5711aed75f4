import random

import pytest
from helpers import arrival_counts, frame, tx
from pyspark.sql import functions as F

from cardwatch.operators.positions import with_position
from cardwatch.operators import velocity
from cardwatch.operators.velocity import CARD, IP, count_in_window, with_velocity


def random_rows(n, seed, span=900_000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.4  # one card and one address hold over a third of the rows
        at = 1_700_000_000_000 + rnd.choice([rnd.randrange(span), rnd.randrange(90) * 10_000])
        rows.append(
            tx(
                i,
                card_hash="hot" if hot else f"c{rnd.randrange(6)}",
                ip=None if rnd.random() < 0.1 else ("1.1.1.1" if rnd.random() < 0.4 else f"ip{rnd.randrange(9)}"),
                ts_ms=None if rnd.random() < 0.1 else at - 1_700_000_000_000 * (i % 11 == 0),
            )
        )
    return rows + [dict(r) for r in rows[::9]]


def expected(rows):
    """Sorted (id, card count, ip count); rows without a time count those so far."""
    timed = sorted((r for r in rows if r["ts_ms"] is not None), key=lambda r: (r["ts_ms"], r["seq"]))
    loose = sorted((r for r in rows if r["ts_ms"] is None), key=lambda r: r["seq"])
    out = []
    for part, windows in ((timed, (60_000, 300_000)), (loose, (1, 1))):
        card = arrival_counts([(r["card_hash"], r["ts_ms"] or 0) for r in part], windows[0])
        ip = arrival_counts([(r["ip"] or "", r["ts_ms"] or 0) for r in part], windows[1])
        out += [(r["id"], c, i) for r, c, i in zip(part, card, ip)]
    return out


def counted(df, **kw):
    return [(r.id, r.card_n, r.ip_n) for r in with_velocity(df, **kw).collect()]


# A limit of 0 takes all buckets by ticks, 20 some, 500,000 none.
@pytest.mark.parametrize("block_windows, hot_rows", [(1, 0), (2, 20), (4, 0), (4, 20), (4, 500_000), (1000, 0)])
def test_any_block_length_equals_one_at_a_time(spark, block_windows, hot_rows, monkeypatch):
    monkeypatch.setattr(velocity, "SEQ_RUN", 7)
    rows = random_rows(600, block_windows)
    got, want = counted(frame(spark, rows), block_windows=block_windows, hot_rows=hot_rows), expected(rows)
    assert len(got) == len(rows)
    # Copies of a row differ in nothing, so each rule's counts are compared as a set.
    for k in (1, 2):
        assert sorted((x[0], x[k]) for x in got) == sorted((x[0], x[k]) for x in want)


def test_window_is_closed_below(spark):
    t = 1_700_000_000_000
    rows = [tx(0, card_hash="a", ts_ms=t), tx(1, card_hash="a", ts_ms=t + 60_000), tx(2, card_hash="a", ts_ms=t + 60_001)]
    for block_windows in (1, 4):
        for hot_rows in (0, 500_000):
            assert sorted(c for _, c, _ in counted(frame(spark, rows), block_windows=block_windows, hot_rows=hot_rows)) == [1, 2, 2]


def test_copies_of_a_row_all_count(spark):
    for hot_rows in (0, 500_000):
        out = with_velocity(frame(spark, [tx(5, card_hash="a", ip="i")] * 40), hot_rows=hot_rows).collect()
        assert sorted(r.card_n for r in out) == sorted(r.ip_n for r in out) == list(range(1, 41))


def test_positions_are_dense_and_copies_spread(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,)] * 20 + [(2,)] * 3, "k int")
    out = with_position(df, ["k"], partitions=8).collect()
    assert sorted(r.position for r in out) == list(range(1, 524))
    assert max(r.position for r in out if r.k == 0) == 20
    assert min(r.position for r in out if r.k == 2) == 521


def test_a_hot_key_never_meets_by_rows(spark):
    """Half of all rows are of one address within one block; no group of the row exchange holds more than a few."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("ip"), F.col("id") % 4000)).alias("ip"),
        F.when(F.col("id") % 10 != 0, F.lit(1_700_000_400_000) + F.col("id") * 7).alias("ts_ms"), F.col("id").alias("seq"),
    )
    plain = count_in_window(rows, IP).agg(F.sum(F.xxhash64("id", "ip_n") % 1_000_003), F.max("ip_n"))
    ticked = count_in_window(rows, IP, hot_rows=1_000)
    assert ticked.agg(F.sum(F.xxhash64("id", "ip_n") % 1_000_003), F.max("ip_n")).collect() == plain.collect()
    narrow = velocity._spread(rows, IP, "ts_ms", 4)
    hot = velocity.hot_buckets(narrow, 1_000)
    assert hot.count() >= 1
    sizes = narrow.join(hot, "_bucket").groupBy("ip", "_block", "ts_ms", F.floor(F.col("seq") / velocity.SEQ_RUN)).count()
    assert sizes.filter("ts_ms IS NOT NULL").agg(F.max("count")).first()[0] == 1


def test_no_bucket_is_hot_where_all_are_alike(spark):
    alike = spark.range(velocity.BUCKETS // 8).select(F.col("id").cast("int").alias("_bucket"), F.explode(F.array_repeat(F.lit(1), 4)))
    assert velocity.hot_buckets(alike, 0).count() == velocity.BUCKETS // 8  # few of all buckets hold rows
    full = spark.range(velocity.BUCKETS).select(F.col("id").cast("int").alias("_bucket"))
    assert velocity.hot_buckets(full, 0).count() == 0


def test_empty_table(spark):
    assert with_velocity(frame(spark, [tx(1)]).limit(0), hot_rows=0).collect() == []


def test_plan_exchanges_rows_once_per_rule_and_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    plan = with_velocity(frame(spark, [tx(1)]), (CARD,))._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("building")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_tick" in line for line in exchanges) == 1
    # All others carry counts: buckets (twice the same), ticks, ticks of a block.
    assert len(exchanges) == 5
