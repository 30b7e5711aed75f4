import random

import pytest
from pyspark.sql import functions as F

from cardwatch import session
from cardwatch.llm import components as stars
from cardwatch.llm import near_dups
from cardwatch.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = brute.word(r)
    return out


def corpus(seed=3):
    r = random.Random(seed)
    base, passage = brute.prose(r, 120), brute.prose(r, 60)
    texts = [" ".join(edited(r, base, r.randint(0, 9))) for _ in range(90)]
    texts += [" ".join(brute.prose(r, r.choice((10, 25, 60))) + passage) for _ in range(40)]
    texts += ["exact COPY of one text with seven words"] * 5 + ["Exact copy  of one\ttext with seven words"]
    texts += [" ".join(brute.prose(r, r.randint(1, 300))) for _ in range(40)]
    texts += ["", None, " \n ", "one", "one", "Two words", "é à ü É"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(7 * i, texts[k]) for i, k in enumerate(order)]


def got(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def test_components_of_all_plans_match_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute.near_duplicates(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("sketch", F.lit("x")).withColumn("node", F.lit(1))
    assert got(near_dups.near_duplicates(docs)) == want
    # Short lists only: everything common goes through families and blocks.
    monkeypatch.setattr(near_dups, "LIST_ROWS", 4)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 16)
    assert got(near_dups.near_duplicates(docs)) == want


def test_rows_without_id_and_with_one_id(spark):
    a, b = "a b c d e f g h", "s t u v w x y z"
    docs = spark.createDataFrame([(None, a), (None, a), (5, a), (5, b), (9, b), (3, a), (4, "")], SCHEMA)
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, None, True)] * 2 + [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (9, 3, False)], key=str)
    assert sorted(r.doc_id or -1 for r in near_dups.deduplicated(docs).collect()) == [-1, -1, 3, 4]
    twice = spark.createDataFrame([(1, a), (1, a), (2, a)], SCHEMA)
    assert [tuple(r) for r in near_dups.deduplicated(twice).collect()] == [(1, a)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dups.near_duplicates(empty).count() == 0
    assert near_dups.deduplicated(empty).count() == 0


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {99: 99, 100: 99}


def test_outer_members_meet_in_bounded_groups_and_only_if_they_can_be_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LIST_ROWS", 4)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 8)
    largest = []
    whole = near_dups._hot_links

    def watched(hot, full):
        counted = near_dups._block_links

        def block(pdf):
            import pandas as pd

            return pd.DataFrame([(int(pdf["outer"].sum()), int((~pdf["outer"]).sum()))], columns=["a", "b"])

        near_dups._block_links = block
        largest.extend((r.a, r.b) for r in whole(hot, full).collect())
        near_dups._block_links = counted
        return whole(hot, full)

    monkeypatch.setattr(near_dups, "_hot_links", watched)
    r = random.Random(11)
    # Half of each text is a template: a family, but no prefix is shared.
    passage = brute.prose(r, 60)
    rows = [(k, " ".join(brute.prose(r, 60) + passage)) for k in range(60)]
    assert got(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute.near_duplicates(rows)
    assert not largest
    # Four fifths are a template: not linked, yet the prefixes meet.
    passage = brute.prose(r, 200)
    rows = [(k, " ".join(brute.prose(r, 46 + k % 5) + passage)) for k in range(80)]
    rows += [(100 + k, " ".join(edited(r, rows[0][1].split(), 1))) for k in range(10)]
    assert got(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute.near_duplicates(rows)
    assert largest and max(max(x) for x in largest) <= 24


def test_components_of_random_edges_match_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, k) for k in range(501, 560)] + [(k, 900 - k) for k in range(510, 530)]
    pairs += pairs[:20] + [(None, 3), (3, None)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(root) and {r.node: r.component for r in found} == {v: find(v) for v in list(root)}


def test_plans_stay_small_and_no_table_goes_through_the_driver(spark, monkeypatch):
    """Each plan of many scans, and each table sent to the driver at once, takes the driver's memory."""
    leaves, staged = [], session.stage_at

    def watched(df, label):
        leaves.append((df._jdf.queryExecution().analyzed().collectLeaves().size(), label))
        return staged(df, label)

    for module in (session, stars, near_dups):
        monkeypatch.setattr(module, "stage_at", watched, raising=False)
    docs = spark.createDataFrame(corpus(), SCHEMA)
    monkeypatch.setattr(near_dups, "LIST_ROWS", 4)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 16)
    monkeypatch.setattr(type(docs), "toPandas", lambda df: pytest.fail("a whole table to the driver"))
    assert got(near_dups.near_duplicates(docs)) == brute.near_duplicates(corpus())
    assert max(leaves)[0] <= 8, sorted(leaves)[-5:]
