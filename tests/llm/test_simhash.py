import random

import numpy as np
from pyspark.sql import functions as F

from cardwatch.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def corpus(seed=5):
    r = random.Random(seed)
    base = brute.prose(r, 400)
    rows = []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = brute.word(r)
        rows.append(" ".join(w))
    rows += [" ".join(brute.prose(r, r.randint(1, 80))) for _ in range(60)]
    rows += ["Copy of one Text"] * 7 + ["copy \x0b of\tone  text ", None, "", " \n", "one", "One", "two words", "É é ü", "a b c a b c a b c a b c"]
    r.shuffle(rows)
    return [(11 * i - 50, t) for i, t in enumerate(rows)]


def got(frame):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect())


def test_fingerprints_and_components_match_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute.simhash(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.lit("x")).withColumn("mask", F.lit(1))
    assert got(simhash.simhash_components(docs)) == want
    # Small buckets and blocks: buckets are dealt again and again, comparisons go in many parts.
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 12)
    monkeypatch.setattr(simhash, "BLOCKS_AT_ONCE", 5)
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 7)
    assert got(simhash.simhash_components(docs)) == want


def test_bucket_links_are_those_of_all_pairs():
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    prints = np.unique(np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 6, dtype=np.uint64)) for _ in range(900)]))
    bucket = np.sort(r.integers(0, 3, len(prints)))
    to = simhash.bucket_links(prints, bucket, list(range(64)))
    want = np.arange(len(prints))
    for _ in range(len(prints)):
        before = want.copy()
        for i in range(len(prints)):
            near = np.flatnonzero((bucket == bucket[i]) & (np.bitwise_count(prints ^ prints[i]) <= 2))
            want[near] = np.minimum(want[near], want[near].min())
        if (before == want).all():
            break
    assert (to == want).all()


def test_parts_cover_the_bits_that_are_left():
    mask = 0
    for _ in range(4):
        parts = [p & (1 << 64) - 1 for p in simhash._parts(mask)]
        assert all(p & mask == mask for p in parts)
        assert parts[0] | parts[1] | parts[2] == (1 << 64) - 1
        assert sum((p ^ mask).bit_count() for p in parts) == 64 - mask.bit_count()
        mask = parts[2]


def test_rows_without_id_and_with_one_id(spark):
    a, b, c = "one text of seven words in all", "quite another text", "and a third one"
    docs = spark.createDataFrame([(None, a), (None, b), (5, a), (5, b), (9, b), (3, c), (3, c), (7, c), (8, None), (6, "")], SCHEMA)
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert rows == sorted([(None, None)] * 2 + [(5, 5), (5, 5), (9, 5), (3, 3), (3, 3), (7, 3), (8, 6), (6, 6)], key=str)


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
