from helpers import frame, tx
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch.functions.rules import DEFAULT_RULES, Rule, apply_rules, decide, tiered
from cardwatch.operators.scoring import score, verdicts


def scored(spark, rows, **kw):
    return {r["id"]: r for r in score(frame(spark, rows), **kw).collect()}


def test_benign_is_approved(spark):
    row = scored(spark, [tx(1)])["tx_1"]
    assert (row.score, row.flags, row.decision) == (0, [], "approve")


def test_a_card_climbs_its_tiers_whatever_others_do(spark):
    """Two cards in turn, thirteen hits each: every hit counts those of its own card so far."""
    out = scored(spark, [tx(i, card_hash=("even", "odd")[i % 2], ip=f"192.0.2.{i}") for i in range(26)])
    tiers = [0] * 3 + [25] * 4 + [50] * 6
    for card in (0, 1):
        mine = [out[f"tx_{i}"] for i in range(card, 26, 2)]
        assert [r.card_n for r in mine] == list(range(1, 14)) and [r.score for r in mine] == tiers
        assert {tuple(r.flags) for r in mine[7:]} == {("card_velocity_extreme",)}


def test_two_weak_signs_together_ask_for_a_review(spark):
    apart = [tx(1, card_bin="356600", country="FR"), tx(2, amount=2345.67), tx(3, card_bin="356600", country="FR", amount=2345.67)]
    out = scored(spark, apart)
    assert [out[f"tx_{i}"].decision for i in (1, 2, 3)] == ["approve", "approve", "review"]
    assert out["tx_3"].score == out["tx_1"].score + out["tx_2"].score
    assert out["tx_3"].flags == out["tx_2"].flags + out["tx_1"].flags


def test_decisions_never_fall_as_the_score_rises(spark):
    rows = spark.range(-5, 200).select("id", decide(F.col("id")).alias("d")).orderBy("id").collect()
    order = ["approve", "review", "decline"]
    ranks = [order.index(r.d) for r in rows]
    assert ranks == sorted(ranks) and set(ranks) == {0, 1, 2}
    first = {d: min(r.id for r in rows if r.d == d) for d in order[1:]}
    assert first == {"review": K.REVIEW_SCORE, "decline": K.DECLINE_SCORE}


def test_edges(spark):
    out = scored(
        spark,
        [
            tx(1, amount=float("nan")),
            tx(2, country=""),
            tx(3, country=None),
            tx(4, card_bin="999999", country="RU"),
            tx(5, amount=5000.0),
            tx(6, amount=1500.0, mcc="6051"),
        ],
    )
    assert out["tx_1"].flags == []
    assert out["tx_2"].flags == out["tx_3"].flags == ["geo_mismatch"]
    assert out["tx_4"].flags == []
    assert (out["tx_5"].score, out["tx_5"].flags) == (45, ["amount_extreme"])
    assert (out["tx_6"].score, out["tx_6"].flags) == (35, ["amount_high", "high_risk_mcc"])


def test_all_rules_add_up(spark):
    rows = [tx(i, card_hash="c", ip="9", amount=9999.0, country="RU", mcc="7995") for i in range(30)]
    last = scored(spark, rows)["tx_29"]
    assert last.score == 175
    assert last.flags == [
        "amount_extreme", "card_velocity_extreme", "ip_fanout_extreme", "geo_mismatch", "high_risk_mcc",
    ]


def test_rules_can_be_replaced(spark):
    model = tiered("model", lambda: F.col("amount") / 10, [(9, 80, "model_high"), (4, 41, "model_mid")])
    passes = Rule("never", lambda: F.lit(0), lambda: F.lit("never"))
    rows = apply_rules(frame(spark, [tx(1, amount=52.5), tx(2, amount=95.0)]), [model, passes]).collect()
    assert [(r.score, r.flags, r.decision) for r in rows] == [
        (41, ["model_mid"], "review"),
        (80, ["model_high"], "decline"),
    ]
    none = apply_rules(frame(spark, [tx(1)]), []).first()
    assert (none.score, none.flags) == (0, [])
    assert [r.name for r in DEFAULT_RULES] == ["amount", "card_velocity", "ip_fanout", "geo_mismatch", "high_risk_mcc"]


def test_verdict_columns(spark):
    row = verdicts(score(frame(spark, [tx(7)]))).first()
    assert (row.tx_id, row.at, row.latency_us, row.card_bin) == ("tx_7", 1_700_000_000_007, 0, "510510")


def test_own_bin_table(spark):
    bins = spark.createDataFrame([("510510", "NO"), ("510510", "SE")], "card_bin string, issuer string")
    assert scored(spark, [tx(1)], bins=bins)["tx_1"].flags == ["geo_mismatch"]
