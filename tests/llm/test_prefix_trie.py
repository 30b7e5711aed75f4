import random

import pytest
from pyspark.sql import functions as F

from cardwatch.llm import prefix_trie as T
from tests.llm import brute

SEQUENCES = "conv_id long, ids array<binary>, words array<long>"
TURNS = "conv_id long, turn int, role string, text string"


def digits(r, letters=4, width=T.WIDTH):
    return bytes(r.choice([0, 1, 127, 128, 255][:letters]) for _ in range(2)) + bytes(width - 2)


def sequences(seed=8, n=160):
    r = random.Random(seed)
    turns = [(digits(r, 5), r.randint(0, 9)) for _ in range(12)]
    turns = list({t[0]: t for t in turns}.values())
    convs = [[r.choice(turns) for _ in range(r.choice((0, 1, 2, 3, 5)))] for _ in range(n)]
    long = [r.choice(turns) for _ in range(130)]
    convs += [long[:120], long, long, long[:60] + turns[:1] + turns[1:2], long[:60]]
    convs += [[turns[0], turns[1]]] * 9
    r.shuffle(convs)
    return {3 * i - 40: c for i, c in enumerate(convs)}


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize(("keys", "turns"), [(20_000, 400_000), (9, 400_000), (1, 1)])
def test_nodes_match_brute_force_however_many_ranges(spark, monkeypatch, keys, turns):
    monkeypatch.setattr(T, "RANGE_KEYS", keys)
    monkeypatch.setattr(T, "RANGE_TURNS", turns)
    convs = sequences()
    rows = [(c, [bytearray(x) for x, _ in t], [w for _, w in t]) for c, t in convs.items()]
    frame = spark.createDataFrame(rows, SEQUENCES).withColumn("key", F.lit("x")).withColumn("n", F.lit(5))
    assert got(T.prefix_trie(frame)) == brute.prefix_trie(convs)


def test_conversations_begin_like_the_first_of_their_group(spark):
    r = random.Random(4)
    texts = ["a few words", "", None, "one\ttwo \x0b three", "Été", "x " * 3000]
    roles = ["user", "assistant", None, ""]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in [*range(-3, 70), 1000, 1003] if c != 40 for t in r.sample([None, *range(9)], r.randint(1, 6))]
    rows += [(200, t, "user", f"turn {t}") for t in range(700)]
    frame = spark.createDataFrame([*rows, (None, 0, "user", "no id")], TURNS).withColumn("place", F.lit(1)).withColumn("words", F.lit("x"))
    # Roles and texts that join to one string are two turns.
    pair = spark.createDataFrame([(5000, 0, "ab", "c"), (5001, 0, "a", "bc")], TURNS).select(T.turn_id(F.col("role"), F.col("text")).alias("id"))
    assert pair.distinct().count() == 2
    want = {c: t for c, t in brute.rebuilt(rows).items()}
    assert got(T.prefix_trie(T.heads_shared(T.numbered_turns(frame)))) == brute.prefix_trie(want)
    assert any(not t for t in want.values())


def test_tree_grows_its_layouts_and_keeps_every_key():
    r = random.Random(0)
    tree = T.RadixTree()
    keys = {bytes([a, b]) + bytes(6) for a in range(256) for b in (0, 9)} | {bytes([7, 9, k, 1] * 2) for k in range(60)} | {b"", b"\x07\x09", bytes([3] * 40), bytes([3] * 20)}
    keys = sorted(keys)
    for i in r.sample(range(len(keys)), len(keys)):
        tree.insert(keys[i], i)
    layouts = set()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        if node.layout:
            layouts.add(node.layout.room)
            assert len(node.children()) <= node.layout.room
        stack += [kid for _, kid in node.children()]
    assert layouts == {4, 16, 48, 256} or layouts == {4, 48, 256} or layouts == {4, 256}
    order, places = tree.turns(2)
    assert order == list(range(len(keys)))
    want = {(d, k[: 2 * d]) for k in keys for d in range(len(k) // 2 + 1)}
    assert {(d, keys[order[lo]][: 2 * d]) for d, lo, _ in places} == want and len(places) == len(want)


def test_layouts_by_number_of_children():
    for n, room in ((1, 4), (4, 4), (5, 16), (17, 48), (48, 48), (49, 256), (256, 256)):
        node = T._Node(b"")
        for byte in random.Random(n).sample(range(256), n):
            node.put(byte, byte + 1)
        assert node.layout.room == room and node.children() == sorted(node.children()) and len(node.children()) == n
        node.put(node.children()[0][0], -1)
        assert len(node.children()) == n and node.children()[0][1] == -1


def test_empty_and_turnless(spark):
    assert T.prefix_trie(spark.createDataFrame([], SEQUENCES)).count() == 0
    assert T.heads_shared(T.numbered_turns(spark.createDataFrame([], TURNS))).count() == 0
    one = T.prefix_trie(spark.createDataFrame([(4, [], []), (2, [], [])], SEQUENCES)).collect()
    assert len(one) == 1 and tuple(one[0])[:7] == (2, 0, None, 2, 0, 1, 0)
