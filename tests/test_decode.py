import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardwatch import schemas
from cardwatch.session import configure, fresh_path
from cardwatch.sources import records
from cardwatch.sources.sinks import transaction_messages, verdict_messages, write_keyed

AT = dt.datetime(2024, 1, 1, 12, 0, 0)
GOOD = '{"id":"a","card_bin":"520082","card_hash":"h","amount":12.5,"currency":"SEK","country":"SE","ip":"1.2.3.4","merchant_id":"m","mcc":"5411","timestamp":"2024-01-02T03:04:05.678+01:00"}'

BAD = {
    "{not json": "invalid JSON",
    "": "empty record",
    "   ": "empty record",
    None: "empty record",
    "[" + GOOD + "]": "not a JSON object",
    '"text"': "not a JSON object",
    "5": "not a JSON object",
    '{"id":5}': "id is not a string",
    '{"mcc":["5411"]}': "mcc is not a string",
    '{"amount":"5"}': "amount is not a number",
    '{"amount":true}': "amount is not a number",
    '{"amount":1e400}': "amount is out of range",
    '{"amount":NaN}': "invalid JSON",
    GOOD + " x": "invalid JSON",
    GOOD + "," + GOOD: "more than one JSON document",
    GOOD + ",null": "more than one JSON document",
    "], [": "invalid JSON",
    GOOD + "]": "invalid JSON",
    GOOD + "] {": "invalid JSON",
    GOOD + ',"x"] {': "invalid JSON",
    '{"timestamp":"yesterday"}': "timestamp is not RFC 3339",
    '{"timestamp":"2024-01-01 00:00:00"}': "timestamp is not RFC 3339",
    '{"timestamp":"2024-13-41T00:00:00Z"}': "timestamp is not RFC 3339",
    '{"timestamp":1700000000}': "timestamp is not RFC 3339",
}


def raw(spark, values):
    rows = [(bytearray(b"k%d" % i), v, "transactions", i % 3, 42 + i, AT) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, schemas.RAW_RECORD)


def test_bad_records(spark):
    out = records.decode(raw(spark, list(BAD))).collect()
    assert {r.value: r.cause for r in out} == BAD
    assert all(r.tx is None for r in out)


def decoded(spark, *values):
    configure(spark)
    out = records.decode(raw(spark, values)).orderBy("offset").collect()
    assert [r.cause for r in out] == [None] * len(values)
    return [r.tx for r in out]


def test_good_records(spark):
    full, empty, null, cased, extra, twice, zero = decoded(
        spark,
        GOOD,
        "{}",
        " null ",
        '{"ID":"u","Amount":3,"Card_Hash":"c"}',
        '{"id":"e","other":{"id":5},"amount":null,"ip":null}',
        '{"id":"x","id":"y"}',
        '{"id":"z","timestamp":"0001-01-01T00:00:00Z"}',
    )
    assert (full.id, full.amount, full.mcc) == ("a", 12.5, "5411")
    assert full.timestamp == dt.datetime(2024, 1, 2, 2, 4, 5, 678000)
    for tx in (empty, null):
        assert (tx.id, tx.card_hash, tx.amount, tx.timestamp) == ("", "", 0.0, AT)
    assert (cased.id, cased.amount, cased.card_hash, cased.country) == ("u", 3.0, "c", "")
    assert (extra.id, extra.amount, extra.ip) == ("e", 0.0, "")
    assert twice.id == "y"
    assert (zero.id, zero.timestamp) == ("z", AT)


def test_dead_letters_and_good_rows_part_ways(spark):
    out = records.decode(raw(spark, ["{not json", GOOD]))
    dead = records.dead_letters(out).collect()
    assert len(dead) == 1 and bytes(dead[0].value) == b"{not json" and bytes(dead[0].key) == b"k0"
    headers = {h.key: bytes(h.value).decode() for h in dead[0].headers}
    assert headers == {
        "cause": "invalid JSON",
        "origin-topic": "transactions",
        "origin-partition": "0",
        "origin-offset": "42",
    }
    good = records.good_transactions(out).collect()
    assert [(r.id, r.ts_ms, tuple(r.seq)) for r in good] == [("a", 1704161045678, (1, 43))]


def test_bodies(spark, tmp_path):
    texts = {
        "good": f'[{GOOD},{{"id":"b"}},null]',
        "empty": "[]",
        "null": "null",
        "object": GOOD,
        "broken": f"[{GOOD}",
        "mixed": f'[{GOOD},{{"id":5}}]',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    bodies = records.body_files(spark, str(tmp_path))
    bodies = bodies.withColumn("body", F.regexp_extract("body", r"([a-z]+)\.json", 1))
    good, bad = records.read_bodies(bodies, F.lit(AT))
    assert sorted((r.body, r.pos, r.id) for r in good.collect()) == [("good", 0, "a"), ("good", 1, "b"), ("good", 2, "")]
    assert {r.id: r.timestamp for r in good.collect()}["b"] == AT
    assert {r.body: r.cause for r in bad.collect()} == {
        "object": "not a JSON array",
        "broken": "invalid JSON",
        "mixed": "id is not a string",
    }


def test_messages_round_trip(spark):
    tx = records.good_transactions(records.decode(raw(spark, [GOOD])))
    sent = transaction_messages(tx)
    assert sent.first().key == "h"
    again = raw(spark, [sent.first().value])
    back = records.good_transactions(records.decode(again)).drop("seq").first()
    assert back == tx.drop("seq").first()


@pytest.mark.parametrize("flags", [[], ["geo_mismatch", "amount_high"]])
def test_verdict_message_leaves_out_empty_flags(spark, flags):
    row = [("t", "b", 1.5, "SEK", "SE", 45, flags, "review", 3, 9)]
    text = verdict_messages(spark.createDataFrame(row, schemas.VERDICT)).first().value
    assert ('"flags"' in text) == bool(flags)
    assert '"latency_us":3' in text and '"at":9' in text


def test_keyed_files_are_in_card_and_time_order(spark):
    rows = spark.createDataFrame([(f"c{i % 3}", 100 - i) for i in range(60)], "card_hash string, ts_ms bigint")
    path = fresh_path(spark, "keyed")
    write_keyed(rows, path, partitions=4)
    back = spark.read.parquet(path).select("*", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    files = {}
    for r in back.orderBy("n").collect():
        files.setdefault(r.f, []).append((r.card_hash, r.ts_ms))
    assert len(files) > 1 and all(v == sorted(v) for v in files.values())
