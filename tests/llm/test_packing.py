import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import packing
from tests.llm import brute

TEXTS = ["", None, "one", "One, two. Three", "<|endoftext|>, x <|startoftext|>", "don't 'S it's, a.b.", "İx. ÉCOLE, é, ΣΑΣ.", "tab\tnew\n\nline\x1c! á,  ", "7 8,9."]


def test_ids_are_those_of_the_tokenizer():
    path = packing.default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = [t or "" for t in TEXTS] + [" ".join(w + r.choice(["", ",", ".", "!!"]) for w in brute.prose(r, 200)).title() for _ in range(20)]
    for _ in range(2):  # the second time from memory
        assert packing.token_ids(texts, path) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("block", [4096, 40])
def test_pieces_and_sequences(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_ROWS", block)
    r = random.Random(6)
    texts = TEXTS + [" ".join(brute.prose(r, int(r.expovariate(1 / 150)) + 1)) for _ in range(150)] + [" ".join(brute.prose(r, 3000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("key", F.lit(1))
    got = packing.pack(docs, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want.append((str(i), k // 2048, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    assert all(zlib.crc32(bytes(x.ids)) == x.ids_crc32 for x in got)
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(x.length for x in got) // 2048)
    assert len(sequences) <= least + (1 if block > 1000 else 8)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_children_are_packings_and_evolution_never_loses():
    r = np.random.default_rng(0)
    for n in (2, 30, 400):
        lengths = np.sort(r.integers(1, 1500, n))[::-1].astype(np.int64)
        first = [packing._decreasing(lengths, noise, r) for noise in (0.6, 0.8, 0.9)]
        for _ in range(10):
            child = packing.crossover(lengths, first[0], first[1], r)
            fill = np.bincount(child, weights=lengths)
            assert len(child) == n and fill.max() <= 2048 and fill.min() > 0 and fill.sum() == lengths.sum()
        before = min(packing.fitness(lengths, p) for p in first)
        assert packing.fitness(lengths, packing.evolve(lengths, first, 1)[0]) <= before


def test_memory_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    memory = packing.Memory()
    memory.keep({"often": b"1", "x" * 100: b"2"})
    for k in range(40):
        assert memory.recall({"often"}) == {"often": b"1"}
        memory.keep({f"once{k}": b"3"})
        assert len(memory.young) + len(memory.old) <= 20
    assert not memory.recall({"once0", "x" * 100}) and memory.recall({"once39", "new"}) == {"once39": b"3"}
    texts = [" ".join(brute.prose(random.Random(k), 60)) for k in range(9)]
    path = packing.default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "_kept", {})
    for t in texts * 2:
        assert packing.token_ids([t], path) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]


def test_blocks_and_islands_are_groups_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(brute.prose(r, r.randint(1, 90)))) for k in range(600)], "doc_id long, text string")
    frames, kind = {}, type(docs)
    monkeypatch.setattr(kind, "groupBy", lambda self, *c, f=kind.groupBy: (frames.setdefault(c, self), f(self, *c))[1])
    packing.pack(docs)
    monkeypatch.undo()
    dealt = frames["block", "island"]
    tasks = dealt.select(F.spark_partition_id().alias("task"), "block", "island").distinct()
    assert tasks.count() == tasks.select("block", "island").distinct().count()  # a group is in one task
    assert tasks.select("task").distinct().count() > 20


def test_ids_of_any_letters_are_those_of_the_tokenizer(monkeypatch, tmp_path):
    path = packing.default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(8)
    ascii_, latin = [chr(c) for c in range(1, 128)], [chr(c) for c in range(0xA0, 0x180)]
    other = list("İıßẞŒΑΣσς漢字한́̈\u2009\u3000’“—😀ªº²½\u200bﬁ\x85\x1c")
    small = list("abcdefgh")
    pools = [ascii_, small, small + latin, latin, small + other, ascii_ + latin + other, small + list("!?.,#&*'<|>"), list("0123456789.,ab")]
    texts = []
    for _ in range(600):
        pool = r.choice(pools)
        words = ["".join(r.choices(pool, k=r.choice([0, 1, 2, 3, 5, 8, 13, 40, 63, 64, 65, 200]))) for _ in range(r.randint(0, 12))]
        texts.append(r.choice([" ", "\n", "  "]).join(words) + r.choice(["", " ", "\n"]))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.token_ids(texts, path) == want
    monkeypatch.setattr(packing, "MERGED_PARTS", 7)
    assert packing.token_ids(texts, path) == want
    # A tokenizer that is built in another way is left to the library.
    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(spec), encoding="utf-8")
    tokenizer, text = Tokenizer.from_file(str(cased)), "three small words, and 4"
    assert packing.merges_of(str(cased)) is None
    assert packing.token_ids([text], str(cased)) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_plain_words_are_not_looked_up_one_by_one(monkeypatch):
    path = packing.default_vocabulary()
    want = Tokenizer.from_file(path).encode("Élan, NEVER met 12.5 (añob)", add_special_tokens=False).ids

    def none(*_):
        raise AssertionError("a word of known letters went to the library")

    monkeypatch.setattr(packing, "_tokenizer", none)
    assert packing.token_ids(["Élan, NEVER met 12.5\n(añob)"], path) == [np.array(want, "<u4").tobytes()]
