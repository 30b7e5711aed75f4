import pytest
from helpers import verdict, verdicts

from cardwatch.session import fresh_path
from cardwatch.streaming.snapshots import SnapshotLog, rate_of, read_snapshot

T0 = 1_700_000_000_000


def batch(spark, number, rows=3):
    return verdicts(spark, [verdict(f"t{number}-{k}", (0, 45, 90)[k % 3], T0 + number * 1000 + k) for k in range(rows)]).drop("seq")


def totals(log):
    return {(r.kind, r.name): r.n for r in log.read()[0].collect() if r.kind != "second"}


def test_reads_open_a_bounded_number_of_files_and_lose_nothing(spark):
    log = SnapshotLog(spark, fresh_path(spark, "log"), fold_after=4)
    opened = []
    for number in range(24):
        log.write(batch(spark, number), "a", number)
        frame, recent = log.read()
        opened.append(len(frame.inputFiles()))
        assert totals(log)["decision", "approve"] == number + 1
    assert max(opened) <= 6
    assert len(log._names("parts/run=*/batch=*")) <= 2 * 5 + 1 and len(log._names("base/*")) <= 2
    assert rate_of(log.read()[0]).first()[0] == 3
    stats, recent = read_snapshot(spark, log.path)
    row = stats.first()
    assert (row.processed, row.approved, row.reviewed, row.declined, row.rate_per_sec) == (72, 24, 24, 24, 3)
    assert [r.at for r in recent.collect()] == sorted((r.at for r in recent.collect()), reverse=True)


def test_a_repeated_micro_batch_counts_once_also_after_a_fold(spark):
    log = SnapshotLog(spark, fresh_path(spark, "log"), fold_after=2)
    for number in (0, 1, 2, 3, 3, 3, 4):  # the fourth is repeated after a fold ran in it
        log.write(batch(spark, number), "a", number)
    assert totals(log)["decision", "review"] == 5
    # A new run numbers from zero again; the old run's parts are kept.
    for number in range(4):
        log.write(batch(spark, 10 + number), "b", number)
    assert totals(log)["decision", "review"] == 9


def test_a_fold_that_did_not_end_changes_nothing(spark, monkeypatch):
    log = SnapshotLog(spark, fresh_path(spark, "log"), fold_after=100)
    for number in range(4):
        log.write(batch(spark, number), "a", number)
    real = log.spark.createDataFrame

    class Torn:
        def __getattr__(self, name):
            return getattr(spark, name)

        def createDataFrame(self, *a, **k):
            raise RuntimeError("lost")

    log.spark = Torn()
    with pytest.raises(RuntimeError):
        log.fold("a", 3)
    log.spark = spark
    assert real is not None and totals(log)["decision", "approve"] == 4
    log.fold("a", 3)
    assert totals(log)["decision", "approve"] == 4 and log._pointer(log._generation()) == {"a": 2}


def test_only_the_rate_history_is_kept(spark):
    log = SnapshotLog(spark, fresh_path(spark, "log"), fold_after=1)
    for number in (0, 200, 201):
        log.write(batch(spark, number), "a", number)
    seconds = [int(r.name) - T0 // 1000 for r in log.read()[0].collect() if r.kind == "second"]
    assert sorted(seconds) == [200, 201] and totals(log)["decision", "approve"] == 3


def test_an_empty_log(spark):
    stats, recent = read_snapshot(spark, fresh_path(spark, "none"))
    row = stats.first()
    assert (row.processed, row.rate_per_sec, row.flagged_rate) == (0, 0, 0.0) and recent.count() == 0
