import os

import pytest
from helpers import verdict, verdicts

from cardwatch.operators import cases
from cardwatch.session import fresh_path
from cardwatch.sources.sinks import CaseTable, status_partitioned

RES = "id string, resolution string, resolved_at bigint, resolved_by string, seq bigint"


def labels(spark, rows):
    return spark.createDataFrame(rows, RES)


def test_open_list_resolve(spark):
    opened = cases.open_cases(verdicts(spark, [verdict("k7", 47, 1), verdict("k8", 83, 2), verdict("k9", 12, 3)]))
    assert [r.id for r in cases.review_queue(opened).collect()] == ["k8", "k7"]
    sent = labels(
        spark,
        [
            ("k7", "false_positive", 10, "ana", 1),
            ("k7", "confirmed_fraud", 11, "ana", 2),
            ("k8", "maybe", 12, "ana", 3),
            ("k5", "confirmed_fraud", 13, "ana", 4),
        ],
    )
    table = cases.resolve_cases(opened, sent)
    assert tuple(cases.case_counts(table).first()) == (1, 0, 1)
    why = {(r.id, r.seq): r.reason for r in cases.rejected_resolutions(opened, sent).collect()}
    assert why == {
        ("k7", 2): cases.NOT_OPEN,
        ("k8", 3): cases.INVALID,
        ("k5", 4): cases.NOT_OPEN,
    }
    export = cases.label_export(table).collect()
    assert [(r.tx_id, r.resolution, r.score) for r in export] == [("k7", "false_positive", 47)]
    assert [r.id for r in cases.list_cases(table, "resolved").collect()] == ["k7"]
    assert [r.id for r in cases.list_cases(table, "anything").collect()] == ["k8"]


def test_first_verdict_wins(spark):
    df = verdicts(spark, [verdict("twin", 71, 8), verdict("twin", 62, 4)])
    assert [(r.id, r.score) for r in cases.open_cases(df).collect()] == [("twin", 62)]


def test_queue_order_and_caps(spark):
    rows = [verdict("a", 50, 1), verdict("b", 50, 3), verdict("c", 90, 2), verdict("d", 50, 3)]
    opened = cases.open_cases(verdicts(spark, rows))
    assert [r.id for r in cases.review_queue(opened).collect()] == ["c", "b", "d", "a"]
    assert [r.id for r in cases.newest_open(opened, 3).collect()] == ["b", "d", "c"]
    newer, older = cases.newest_open(opened, 4), cases.newest_open(opened, 3)
    assert [r.id for r in cases.queue_diff(newer, older).collect()] == ["a"]


def rows_of(table):
    return sorted((r.id, r.status, r.resolution, r.score) for r in table.read().collect())


def test_stream_and_analysts_write_side_by_side(spark):
    table = CaseTable(spark, fresh_path(spark, "table"))
    assert table.read().count() == 0
    assert table.add("run1-0", verdicts(spark, [verdict("p", 55, 1), verdict("q", 81, 2)]))
    # A repeated part changes nothing, whatever it holds; a label part may have any name.
    assert not table.add("run1-0", verdicts(spark, [verdict("z", 51, 9)]))
    assert table.label("run1-0", labels(spark, [("q", "confirmed_fraud", 5, "x", 1)]))
    assert not table.label("run1-0", labels(spark, [("p", "confirmed_fraud", 5, "x", 1)]))
    table.add("run1-1", verdicts(spark, [verdict("p", 97, 3), verdict("r", 43, 4)]))
    want = [("p", "open", None, 55), ("q", "resolved", "confirmed_fraud", 81), ("r", "open", None, 43)]
    assert rows_of(table) == want
    table.compact()
    assert rows_of(table) == want
    # One case for life: a fresh run numbers from zero, and a replay after the label does not reopen.
    table.add("run2-0", verdicts(spark, [verdict("q", 81, 6), verdict("s", 44, 7)]))
    table.label("later", labels(spark, [("r", "false_positive", 8, "x", 2), ("q", "false_positive", 9, "x", 3)]))
    table.compact()
    assert rows_of(table) == [
        ("p", "open", None, 55),
        ("q", "resolved", "confirmed_fraud", 81),
        ("r", "resolved", "false_positive", 43),
        ("s", "open", None, 44),
    ]
    assert sorted(r.id for r in table.open().collect()) == ["p", "s"]
    path = fresh_path(spark, "by-status")
    status_partitioned(table.read(), path)
    assert spark.read.parquet(path).filter("status = 'open'").count() == 2


def test_half_written_parts_are_not_seen_and_faults_are_raised(spark):
    table = CaseTable(spark, fresh_path(spark, "table"))
    table.add(0, verdicts(spark, [verdict("p", 52, 1)]))
    table._write(cases.open_cases(verdicts(spark, [verdict("lost", 50, 2)])), "opened", 1)
    assert [r.id for r in table.read().collect()] == ["p"]
    table.add(1, verdicts(spark, [verdict("q", 53, 3)]))
    assert sorted(r.id for r in table.read().collect()) == ["p", "q"]
    with pytest.raises(Exception):  # noqa: B017  any fault but a missing path
        CaseTable(spark, "nosuchscheme://x")._commits()


def files_under(path):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_the_table_folds_itself_and_its_files_do_not_grow(spark):
    """Eight micro-batches with repeats of old ids: one case per id, whole history known, files bounded."""
    path = fresh_path(spark, "table")
    table = CaseTable(spark, path, fold_every=2, buckets=4)
    opened, sizes = {}, []
    for k in range(8):
        mine = [(f"id{k}", 50 + k), (f"id{k // 2}", 99), ("hot", 60 + k)]
        table.add(f"run-{k}", verdicts(spark, [verdict(i, score, k) for i, score in mine]))
        for i, score in mine if mine[0][0] != mine[1][0] else [mine[1], mine[2]]:
            opened.setdefault(i, score)
        if k == 3:
            table.label("a/b *?", labels(spark, [("hot", "confirmed_fraud", 5, "x", 1)]))
        sizes.append(files_under(path))
    want = {i: ("resolved" if i == "hot" else "open") for i in opened}
    assert {r.id: r.status for r in table.read().collect()} == want
    assert table.read().count() == len(want)
    assert max(sizes[4:]) <= max(sizes[:4]) + 8
    # A part of a fold long ago is still known, and a label still meets its case.
    assert not table.add("run-0", verdicts(spark, [verdict("other", 90, 1)]))
    assert not table.label("a/b *?", labels(spark, [("id3", "false_positive", 9, "x", 1)]))
    assert table.label("later", labels(spark, [("id3", "false_positive", 9, "x", 1), ("hot", "false_positive", 9, "x", 2)]))
    assert {(r.id, r.resolution) for r in table.resolved().collect()} == {("hot", "confirmed_fraud"), ("id3", "false_positive")}


def test_a_batch_reads_only_the_buckets_of_its_ids(spark):
    table = CaseTable(spark, fresh_path(spark, "table"), fold_every=1, buckets=16)
    table.add(0, verdicts(spark, [verdict(f"t{i}", 50, i) for i in range(200)]))
    few = spark.createDataFrame([("t7",), ("new",)], "id string")
    known = table.known_ids(few)
    assert known.join(few, "id", "left_semi").collect() == [("t7",)]
    assert known.count() < 60
    assert "PartitionFilters: [bucket" in known._jdf.queryExecution().executedPlan().toString()
    assert table.known_ids(few.limit(0)).count() == 0


def test_a_fold_that_stopped_half_way_is_not_seen(spark):
    table = CaseTable(spark, fresh_path(spark, "table"), fold_every=100)
    table.add(0, verdicts(spark, [verdict("p", 52, 1)]))
    table._open(-1, []).write.parquet(f"{table.path}/open-cases/generation=0")
    assert [r.id for r in table.read().collect()] == ["p"]
    table.compact()
    assert [r.id for r in table.read().collect()] == ["p"]
    table.add(1, verdicts(spark, [verdict("p", 77, 2), verdict("q", 53, 3)]))
    assert sorted((r.id, r.score) for r in table.read().collect()) == [("p", 52), ("q", 53)]
