import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import decontaminate
from tests.llm import brute


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def corpus(n=300):
    r = random.Random(8)
    items = [(k, " ".join(brute.prose(r, r.randint(15, 60)))) for k in range(20)] + [(20, None), (21, ""), (22, "too few words"), (None, "a b c d e f g h i j k l m n o p")]
    docs, want = [], set()
    for k in range(n):
        words = brute.prose(r, r.randint(5, 400))
        if k % 5 == 0:
            item, text = items[r.randrange(20)]
            part = text.split()
            if k % 10 == 0:  # a paraphrase: some words dropped, some new, the answer as it is
                part = [brute.word(r) if r.random() < 0.1 else w for w in part[:-6] if r.random() > 0.12] + part[-6:]
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "!!" if k % 15 == 0 else w for w in part]
            want.add((k, item))
        docs.append((k, " ".join(words)))
    return docs, items, want


def test_planted_items_are_found_and_clean_documents_left_alone(spark):
    docs, items, want = corpus()
    rows = docs + [(1000, None), (1001, ""), (None, docs[0][1]), (0, docs[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("terms", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(frame, bench).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert len(want & found) >= 0.97 * len(want)
    assert {d for d, _ in found} <= {d for d, _ in want} | {None}
    assert sum(x.doc_id == 0 for x in got) == 2
    clean = decontaminate.without_leaks(frame, bench)
    assert clean.columns == frame.columns
    assert clean.count() == len(rows) - len({d for d, _ in found} - {None}) - 2
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(frame, bench.limit(0)).count() == len(rows)


def test_common_words_is_the_longest_common_subsequence():
    r = random.Random(0)
    for _ in range(100):
        a, b = [[r.randrange(6) for _ in range(r.randint(1, 30))] for _ in range(2)]
        assert decontaminate.common_words(decontaminate._masks(a), len(a), b) == lcs(a, b)


def test_latent_space_is_that_of_the_matrix(spark):
    """Against an exact factorisation: the space holds nearly all that one of its rank can."""
    docs, _, _ = corpus(120)
    space = decontaminate.LatentSpace.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    basis, _ = np.linalg.qr(space.table.astype(float) / np.where(space.weights > 0, space.weights, 1)[:, None])
    rows = []
    for batch in decontaminate._stored(iter([__import__("pyarrow").record_batch({"text": [t for _, t in docs]})])):
        for terms, first in decontaminate._stored_slices(batch.column("terms")):
            for a, b in zip(first[:-1], first[1:]):
                for k in range(a, b, decontaminate.WINDOW):
                    part = terms[k : min(k + decontaminate.WINDOW, b)]
                    row = np.zeros(decontaminate.TERMS)
                    np.add.at(row, part, space.weights[part])
                    rows.append(row / np.sqrt(np.square(space.weights[part]).sum()))
    matrix = np.array(rows)
    best = np.square(np.linalg.svd(matrix, compute_uv=False)[: decontaminate.RANK]).sum()
    assert np.square(matrix @ basis).sum() >= 0.5 * best


def test_short_items_and_scripts_without_spaces(spark):
    r = random.Random(4)
    items = [(k, " ".join(brute.prose(r, 3 + k % 10))) for k in range(100)]
    items += [(100, "水の沸点は何度ですか"), (101, "什么是光合作用？"), (102, "GDP 是什么意思")]
    docs = []
    for k, text in items:
        words = brute.prose(r, 120)
        at = r.randrange(121)
        words[at:at] = [w.upper() + "," for w in text.split()] if k < 100 else ["前文" + text + "後文" if k < 102 else "(" + text + "後文"]
        docs.append((k, " ".join(words)))
    docs += [(1000 + k, " ".join([*t.split()[:-1], "other", *brute.prose(r, 40)])) for k, t in items[:100:10]] + [(2000, "xgdp 是什么意思"), (2001, "水の沸点は")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.copied) for x in decontaminate.leaks(frame, bench).collect())
    assert got == [(k, k, True) for k, _ in items]


def _space():
    r = np.random.default_rng(3)
    table = r.standard_normal((decontaminate.TERMS, 24)).astype(np.float32)
    return decontaminate.LatentSpace(table, np.ones(24), np.ones(decontaminate.TERMS, np.float32))


def test_rare_words_lose_no_window_that_a_leak_needs():
    """Every window against every item, word by word, finds the same leaks."""
    r = random.Random(9)
    items = [(k, " ".join(brute.prose(r, n))) for k, n in enumerate([8, 9, 12, 15, 23, 24, 31, 60, 90])]
    texts = []
    for _ in range(60):
        words = r.choice(items)[1].split()
        kept = [w if r.random() > r.choice((0, 0.1, 0.25, 0.35)) else brute.word(r) for w in words]
        filler = brute.prose(r, r.randint(0, 80))
        at = r.randint(0, len(filler))
        texts.append(" ".join(filler[:at] + kept + filler[at:]))
    bench = decontaminate.Benchmark(items, _space())
    found, want = set(), set()
    for i, _, words in decontaminate.slices(pa.array(texts), apart=decontaminate.MARKS, most=2000):
        for k, leaks in enumerate(bench.search(words)):
            found |= {(i + k, item, copy) for item, _, _, copy in leaks}
        hashes, terms = words.hashes(), (words.hashes() % np.uint64(decontaminate.TERMS)).astype(np.int64)
        for d in range(words.texts):
            a, b = int(words.first[d]), int(words.first[d + 1])
            for number, (item, size, masks, answer_size, answer) in enumerate(bench.items):
                plans = [(decontaminate.STEP, decontaminate.STEPS, bench.vectors, bench.sizes, bench.owner)] + [(s, 4, *x) for s, x in bench.short.items()]
                for step, count, parts, sizes, owner in plans:
                    for start in range(a, b, step):
                        if start > a and start + step * (count - 1) >= b:
                            continue
                        end = min(start + step * count, b)
                        vector = decontaminate._unit(bench.table[terms[start:end]].sum(axis=0)[None])
                        mine = np.flatnonzero(owner == number)
                        near = mine[(vector @ parts[mine].T)[0] >= decontaminate.NEAR] if len(mine) else mine
                        n = len(near)
                        full = lambda v: np.full(n, v)
                        if not n or not bench._share_terms(terms, full(start), full(b), full(number), sizes[near], step * count).any():
                            continue
                        region = hashes[max(a, start - size) : min(b, start + step * count + size)].tolist()
                        share = decontaminate.common_words(masks, size, region) / size
                        if share >= decontaminate.COPY:
                            want.add((i + d, item, True))
                        elif share >= decontaminate.PARAPHRASE and decontaminate.common_words(answer, answer_size, region) >= decontaminate.ANSWER * answer_size:
                            want.add((i + d, item, False))
    copies = {x[:2] for x in want if x[2]}
    want = {(d, item, (d, item) in copies) for d, item, _ in want}
    assert len(want) > 30 and want <= found
    assert {x[:2] for x in found} - {x[:2] for x in want} <= {(d, i) for d, i, copy in found if copy}  # exact sequences of short items


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25])
def test_paraphrases_are_found(share):
    r = random.Random(int(share * 100))
    items = [(k, " ".join(brute.prose(r, 45))) for k in range(40)]
    bench = decontaminate.Benchmark(items, _space())
    texts = []
    for _, text in items:
        words = text.split()
        for at in r.sample(range(len(words) - 6), int(share * len(words))):
            words[at] = brute.word(r)
        texts.append(" ".join(brute.prose(r, 70) + words + brute.prose(r, 50)))
    found = []
    for _, _, words in decontaminate.slices(pa.array(texts), apart=decontaminate.MARKS):
        found += [{item for item, *_ in leaks} for leaks in bench.search(words)]
    assert sum(k in own for k, own in enumerate(found)) >= 0.95 * len(items)


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_run_sums_are_those_of_the_rows(width):
    r = np.random.default_rng(3)
    table, sizes = r.random((50, 7)), r.integers(1, 30, 40)
    at, begin = r.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    want = np.add.reduceat(table[at], begin, axis=0)
    assert np.allclose(decontaminate._run_sums(table, at, begin, width), want)


def test_products_of_several_slices_are_those_of_the_passages(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(brute.prose(r, n)) for n in (100, 0, 1, 24, 25, 700)]
    weights = np.random.default_rng(1).random(decontaminate.TERMS).astype(np.float32) + 0.5
    want = np.zeros((decontaminate.TERMS, decontaminate.RANK + decontaminate.MORE))
    stored = [b for t in texts for b in decontaminate._stored(iter([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])]))]
    for batch in stored:
        terms = np.frombuffer(batch.column("terms")[0].as_py(), "<u2").astype(int)
        for a in range(0, len(terms), decontaminate.WINDOW):
            row = np.zeros(decontaminate.TERMS)
            np.add.at(row, terms[a : a + decontaminate.WINDOW], weights[terms[a : a + decontaminate.WINDOW]].astype(float))
            square = np.square(weights[terms[a : a + decontaminate.WINDOW]].astype(float)).sum()
            want += np.outer(row, row @ decontaminate._directions()) / square
    for words in (1, 200, 1 << 19):
        monkeypatch.setattr(decontaminate, "WORDS_BACK", words)
        (got,) = decontaminate._products(weights)(iter(stored))
        have = np.zeros_like(want)
        have[got.column("term").to_numpy()] = np.stack([got.column(c).to_numpy() for c in decontaminate._columns()], axis=1)
        assert np.allclose(have, want, rtol=1e-3, atol=1e-3)
