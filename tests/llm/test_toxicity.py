import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import toxicity
from cardwatch.llm.words import MARKS, slices
from tests.llm import brute


def rows(n=400, seed=2):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = brute.prose(r, r.randint(5, 80))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(["zugrob", "Zugrobheit,", "vilmox!", "vilmoxes"])
        out.append((k, " ".join(words), "en" if k % 3 else "de", int(toxic)))
    return out


def test_scores_of_held_out_rows(spark):
    data = rows()
    docs = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string").withColumn("score", F.lit("extra"))
    labels = spark.createDataFrame([(x[0], x[3]) for x in data if x[0] % 5] + [(1, None), (2, 7), (10_000, 1)], "doc_id long, toxic int")
    model = toxicity.Toxicity.fit(docs, labels)
    more = docs.union(spark.createDataFrame([(None, None, None, ""), (1, "", "xx", "")], docs.schema))
    got = model.scored(more, "p", "hit").collect()
    assert len(got) == len(data) + 2 and all(0 <= r.p <= 1 for r in got)
    held = [(r.p >= 0.5) == (r.doc_id % 4 == 0) for r in got[: len(data)] if r.doc_id % 5 == 0]
    assert np.mean(held) >= 0.95
    assert not got[-1].hit and not got[-2].hit
    assert model.scored(docs.limit(0), "p", "hit").count() == 0


@pytest.mark.parametrize("given,prior", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_labels_of_one_kind(spark, given, prior):
    docs = spark.createDataFrame([(k, "a b", "en") for k in range(4)], "doc_id long, text string, lang string")
    model = toxicity.Toxicity.fit(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
    assert {r.score for r in model.scored(docs).collect()} <= {0.0, prior}


def test_folded_table_scores_like_the_plain_network():
    model = toxicity.Model.new(1, 0.3)
    texts = ["", "one", "two words", " ".join(brute.prose(random.Random(1), 50)), "é!! ü"]
    table = model.table()
    got = np.concatenate([toxicity.score_words(w, table, model.shift, model.out, float(model.bias[0])) for _, _, w in slices(pa.array(texts), apart=MARKS)])
    for text, score in zip(texts, got):
        (_, _, w), = slices(pa.array([text]), apart=MARKS)
        buckets, first, end = toxicity._inputs(w)
        h = model.vectors[buckets].sum(axis=0)
        logit = model.bias[0]
        for k, filters in enumerate(model.filters):
            places = [sum(h[i + j] @ f for j, f in enumerate(filters)) + model.shift[k] for i in range(first[0], end[0])]
            logit = logit + np.maximum(np.max(places, axis=0), 0) @ model.out[k]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_threshold_has_the_fewest_errors():
    scores, labels = np.array([0.1, 0.2, 0.7, 0.9]), np.array([0, 0, 1, 1])
    assert toxicity._threshold(scores, labels) == pytest.approx(0.45)


def test_repeated_labels_and_documents_neither_fill_nor_exceed_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", {1: 20, 0: 20})
    monkeypatch.setattr(toxicity, "CALIBRATE_ROWS", {1: 0, 0: 0})
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda inputs, y: seen.extend((x.tobytes(), k) for x, k in zip(inputs, y)) or toxicity.Model.new(1, 0.5))
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', 10000 * id) AS text", "'en' AS lang")
    copies = spark.range(300).selectExpr("1L AS doc_id", "concat('text ', 10000 * (id % 50)) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    repeated = spark.range(500).selectExpr("id % 10 AS doc_id", "CAST(id % 2 AS int) AS toxic")
    toxicity.Toxicity.fit(docs.union(copies), labels.union(repeated))
    assert {y: sum(x == y for _, x in seen) for y in (0, 1)} == {0: 20, 1: 20}
    assert len(set(seen)) == 40 and len({t for t, y in seen if y == 1}) == 20


def test_documents_are_scanned_once_and_the_driver_gets_no_text(spark, monkeypatch, tmp_path):
    spark.createDataFrame([x[:3] for x in rows(60)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS int) AS toxic")
    staged, real = [], toxicity.stage_at
    monkeypatch.setattr(toxicity, "stage_at", lambda df, label: staged.append(df) or real(df, label))
    monkeypatch.setattr(toxicity, "STEPS", 1)
    toxicity.Toxicity.fit(docs, spark.createDataFrame(labels.collect(), labels.schema))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in staged]
    assert sum("FileScan" in line and str(tmp_path)[:40] in line for p in plans for line in p.splitlines()) == 1
    assert all("text" not in df.columns for df in staged)


def test_a_mini_batch_in_parts_has_the_gradient_of_the_whole(monkeypatch):
    r = random.Random(3)
    inputs = [x for x, _ in toxicity.buckets_of(pa.array([" ".join(brute.prose(r, n)) for n in (1, 40, 7, 0, 300)]))]
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.full(5, 0.2)
    model = toxicity.Model.new(1, 0.3)
    whole = toxicity._gradients(model, *toxicity._side_by_side(inputs), y, w)
    monkeypatch.setattr(toxicity, "PLACES_AT_ONCE", 50)
    parts = list(toxicity._parts(range(5), inputs))
    assert len(parts) > 2 and sum(parts, []) == list(range(5))
    total = [sum(g) for g in zip(*(toxicity._gradients(model, *toxicity._side_by_side([inputs[i] for i in p]), y[p], w[p]) for p in parts))]
    for a, b in zip(whole, total):
        assert np.allclose(a, b, atol=1e-6)


def test_rows_beyond_the_sample_are_learned_and_set_thresholds(spark, monkeypatch):
    r = random.Random(4)
    toxic = [x + y for x in ("zug", "vil", "krat", "blon") for y in ("rob", "mox")]
    data = []
    for k in range(4000):
        words = brute.prose(r, r.randint(5, 20))
        if k % 3 == 0:  # the sample holds some of these words only
            words[r.randrange(len(words))] = toxic[k // 3 % 8]
        data.append((k, " ".join(words), "en", int(k % 3 == 0)))
    docs = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string").repartition(2)
    labels = spark.createDataFrame([(x[0], x[3]) for x in data if x[0] % 5], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", {1: 4, 0: 12})
    monkeypatch.setattr(toxicity, "CALIBRATE_ROWS", {1: 0, 0: 0})
    got = toxicity.Toxicity.fit(docs, labels).scored(docs).filter("doc_id % 5 = 0").collect()
    assert np.mean([x.flagged == (x.doc_id % 3 == 0) for x in got]) >= 0.9


def test_tasks_that_never_met_a_word_do_not_hold_its_vector_back(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TASK_ROWS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    texts = ["alpha beta", "gamma delta"]
    stored = [x for x, _ in toxicity.buckets_of(pa.array(texts))]
    rows = spark.createDataFrame([(k, k % 2, bytes(stored[k % 2].tobytes())) for k in range(8)], "doc_id long, toxic int, buckets binary")
    model = toxicity.Model.new(1, 0.5)
    before = model.rows()
    toxicity.train_on(model, rows.repartitionByRange(2, "toxic"), 8, 0.5)
    moved = np.abs(model.rows() - before).max(axis=1)[: toxicity.BUCKETS + 1]
    met = np.unique(np.concatenate([x.ravel() for x in stored]))
    assert moved[np.setdiff1d(np.arange(toxicity.BUCKETS + 1), met)].max() == 0
    assert (moved[np.setdiff1d(met, [toxicity.BUCKETS])] > 0).sum() >= 2


def test_threshold_of_counted_scores_is_that_of_their_rows():
    scores, toxic, clean = np.array([0.1, 0.4, 0.6, 0.9]), np.array([1, 2, 0, 5]), np.array([7, 1, 2, 0])
    y = np.concatenate([np.repeat([1, 0], [t, c]) for t, c in zip(toxic, clean)])
    assert toxicity._threshold(scores, toxic, clean) == toxicity._threshold(np.repeat(scores, toxic + clean), y)


def test_map_of_labelled_ids_loses_none_and_lets_few_others_in(spark):
    rows = spark.range(0, 3000, 3).selectExpr("id - 600 AS doc_id")
    docs = spark.range(3000).selectExpr("CAST(id - 600 AS int) AS doc_id")
    got = {x.doc_id for x in docs.filter(toxicity._perhaps_labelled(rows, 1000)).collect()}
    assert set(range(-600, 2400, 3)) <= got and len(got) < 1400


def test_the_sample_comes_to_the_driver_in_parts(spark, monkeypatch):
    data = rows(200)
    docs = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in data], "doc_id long, toxic int")
    whole, given = type(docs).toPandas, []
    monkeypatch.setattr(type(docs), "toPandas", lambda df: given.append(df.columns) or whole(df))
    model = toxicity.Toxicity.fit(docs, labels)
    assert given and not any("buckets" in columns for columns in given)
    assert model.arrays is not None
