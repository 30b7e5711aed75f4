import random

import numpy as np
from pyspark.sql import functions as F

from cardwatch.llm import phrases
from tests.llm import brute

SCHEMA = "text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus(seed=2):
    r = random.Random(seed)
    words = [brute.word(r) for _ in range(14)] + ["Été", "été", "ZU", "zu"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?", " ; "]
    rows = []
    for k in range(60):
        text = "".join(r.choice(words[: 5 + k % 14]) + r.choice(marks) for _ in range(r.randint(0, 60)))
        rows.append((text, ["en", "de", None, "und", "En"][k % 5]))
    rows += [(None, "en"), ("", None), (" .,\n", "fr"), ("one", "it")] + [rows[3]] * 3
    rows += [("very common pair " * 200, "en"), ("a a a a a a a a a", "es"), ("x" * 70_000 + " y", "es")]
    return rows


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(r) for r in frame.collect())


def test_phrases_match_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("w1", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    want = brute.phrases(rows, 4, 80, 25)
    assert len(want) > 40
    assert got(phrases.collocations(docs, least=4, top=25)) == want
    # Every range holds a few pointers, tasks hand their counts on at once, and maps are full of shared bits.
    monkeypatch.setattr(phrases, "RANGE_ROWS", 20)
    monkeypatch.setattr(phrases, "HELD", 3)
    monkeypatch.setattr(phrases, "WORD_BITS", 6)
    monkeypatch.setattr(phrases, "PAIR_BITS", 7)
    assert got(phrases.collocations(docs, least=4, top=25)) == want


def test_quicksort_gives_every_frequent_prefix():
    r = np.random.default_rng(3)
    words = r.integers(-2, 3, (phrases.DEPTH, 500))
    words[0][words[0] == 0] = 9
    for k in range(1, phrases.DEPTH):
        words[k][words[k - 1] == 0] = 0
    n = r.integers(1, 5, 500)
    want = {}
    for i in range(500):
        for depth in range(2, phrases.DEPTH + 1):
            p = tuple(int(x) for x in words[:depth, i])
            if 0 not in p:
                want[p] = want.get(p, 0) + int(n[i])
    found = phrases.frequent_prefixes(words, n, 40)
    assert dict(found) == {p: c for p, c in want.items() if c >= 40} and len(found) == len(dict(found))


def test_counts_beyond_64_bits_of_product_are_exact(spark):
    many = (1 << 45) + 1
    rows = spark.createDataFrame([(many, many + 2, many + 3)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = rows.select((F.lit(2 * phrases.SCALE).cast("decimal(19,0)") * wide("a")).alias("twice"), (wide("l") + wide("r")).alias("both")).selectExpr("twice div both AS score").first()
    assert out.score == 2 * phrases.SCALE * many // (2 * many + 5)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
