import random

import corpus_pipeline
from cardwatch.llm import decontaminate
from tests.llm import brute
from tests.llm.test_toxicity import rows as labelled  # noqa: F401


def test_stages_on_planted_rows(spark, tmp_path):
    r = random.Random(3)
    tox = labelled(700)
    docs = [(k, t, lang, "s", len(t)) for k, t, lang, _ in tox]
    base = " ".join(brute.prose(r, 100))
    item = " ".join(brute.prose(r, 40))
    docs += [(1000 + k, base + " x" * k, "en", "s", 0) for k in range(3)]
    docs += [(2000, " ".join(brute.prose(r, 50)) + " " + item + " thea", "en", "s", 0), (3000, " ".join(brute.prose(r, 30)) + " a@b.co", "de", "t", 0)]
    docs += [(4000, None, None, None, None), (None, "no id here", "en", None, 0), (3000, "another text of the same row id", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, _, _, y in tox], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {name: {x.doc_id for x in rows} for name, rows in after.items()}
    toxic = {k for k, _, _, y in tox if y}
    assert len(kept["toxicity"] & toxic) <= 0.05 * len(toxic)
    assert len(kept["toxicity"] - toxic) >= 0.97 * (len(tox) - len(toxic))
    assert kept["toxicity"] - kept["near_duplicates"] == {1001, 1002} and len([x for x in after["near_duplicates"] if x.doc_id == 3000]) == 1
    assert kept["near_duplicates"] - kept["decontamination"] == {2000}
    assert kept["personal_data"] == kept["decontamination"] == kept["packing"] and {4000, None} <= kept["packing"]
    assert [x.text for x in after["personal_data"] if x.text and "@" in x.text] == []
    assert all(x.n_chars == len(x.text) for x in after["personal_data"] if x.text is not None)


def test_share_of_a_paraphrase_stays_above_chance():
    assert decontaminate.PARAPHRASE >= 0.6 and corpus_pipeline.ORACLE_SQL is None
