import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import importance
from cardwatch.llm.words import slices
from tests.llm import brute


def test_ratios_match_counting_and_junk_goes_first(spark):
    r = random.Random(9)
    rows = [(k, " ".join(w + ("%%%" if k % 10 == 0 else "") for w in brute.prose(r, r.randint(1, 60)))) for k in range(200)]
    rows += [(200, None), (201, ""), (5, rows[5][1]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("place", F.lit(2))
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(0, 200, 2)] + [(999, 1), (None, 1)], "doc_id long, quality int")
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(rows) and sum(x.kept for x in got) == math.ceil(0.9 * len(rows))

    def grams(text):
        (_, _, w), = slices(pa.array([text or ""]))
        return importance._ngrams(w)[0].tolist()

    own = [(i, grams(t)) for i, t in rows]
    raw = Counter(b for _, g in own for b in g)
    target = Counter(b for i, g in own if i is not None and i < 200 and i % 2 == 0 and i % 10 for b in g)
    model = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + importance.BUCKETS))
    want = sorted((str(i), len(g), round(sum(model(target, b) - model(raw, b) for b in g) / max(len(g), 1), 9)) for i, g in own)
    assert sorted((str(x.doc_id), x.n_ngrams, round(x.log_ratio, 9)) for x in got) == want
    junk = [x.kept for x in got if x.doc_id is not None and x.doc_id < 200 and x.doc_id % 10 == 0]
    assert sum(junk) <= 0.4 * len(junk)


@pytest.mark.parametrize("labelled", [[], [(1, 0)]])
def test_without_a_target_or_rows(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(10)], "doc_id long, text string")
    got = importance.resample(docs, labels).collect()
    assert {x.log_ratio for x in got} == {0.0} and sum(x.kept for x in got) == 9
    assert importance.resample(docs.limit(0), labels).count() == 0


def test_the_target_is_every_labelled_good_document(spark):
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id) AS text")
    got = importance.resample(docs, docs.selectExpr("doc_id", "1 AS quality"))
    # Target and raw counts are the same, so no n-gram tells them apart.
    assert got.filter("abs(log_ratio) > 1e-12").count() == 0 and got.count() == n


def test_a_repeated_row_weighs_once_in_the_target(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "g h")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    more = docs.union(docs.filter("doc_id = 1"))
    got = {r.doc_id: r.log_ratio for r in importance.resample(more, labels).collect()}
    # Raw text has the first document twice, the target once.
    assert got[1] < got[2]
