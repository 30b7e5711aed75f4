import random

from pyspark.sql import functions as F

from cardwatch.llm import quality
from tests.llm import brute


def test_statistics_and_verdicts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "LINE_DOCUMENTS", 3)
    monkeypatch.setattr(quality, "LINE_SHARE", 0.1)
    r = random.Random(5)
    common = [" ".join(brute.prose(r, n)) for n in (3, 30, 60)]
    rows = []
    for k in range(60):
        lines = [" ".join(brute.prose(r, r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        lines += [x.upper() if r.random() < 0.5 else "  " + x for x in common if r.random() < 0.4]
        lines += lines[:1] * (k % 3) + ["# <a> $|%&*"] * (k % 2)
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), ("a", "b", None)[k % 3 if k < 50 else 0]))
    rows += [(60, None, "a"), (61, "", None), (62, "the same word " * 40, "b"), (62, "the same word " * 40, "b"), (63, "é\x0bü " * 60 + "\n\n\x1c", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1)).withColumn("row", F.lit(2))
    out = quality.quality_rules(docs)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")) for r in out.collect())
    assert got == sorted(brute.quality(rows, 3, 0.1))
    assert any(g[7] < g[1] for g in got) and quality.quality_rules(docs.limit(0)).count() == 0


def test_common_lines_are_cut_by_number(spark, monkeypatch):
    monkeypatch.setattr(quality, "LINE_DOCUMENTS", 1)
    docs = spark.createDataFrame([(k, f"Menu  here\nown {k}\n\nmenu HERE", "s") for k in range(3)], "doc_id long, text string, source string")
    rows = quality.quality_rules(docs).join(docs, "doc_id").select("doc_id", "common_lines", quality.cut_lines(F.col("text"), F.col("common_lines")).alias("t")).collect()
    assert {(r.doc_id, tuple(r.common_lines), r.t) for r in rows} == {(k, (0, 3), f"own {k}\n") for k in range(3)}


def test_a_passage_is_common_at_a_host_of_any_size(spark):
    r = random.Random(6)
    passage = " ".join(brute.prose(r, 60))
    rows = [(k, passage if k < 300 else f"own {k}", "big") for k in range(70_000)] + [(100_000 + k, passage, "small") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = quality.quality_rules(docs).filter("doc_id < 300 or doc_id >= 100000")
    assert {(x.common_lines[0], x.words_left, x.kept) for x in held.collect()} == {(0, 0, False)} and held.count() == 600
