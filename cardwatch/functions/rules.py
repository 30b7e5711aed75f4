"""Rules as Column expressions, and the chain that turns them into a verdict."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import constants as K


@dataclass(frozen=True)
class Rule:
    """A named rule. ``points`` is 0 and ``flag`` null where the rule passes.

    Both are built from the columns of the scored frame, so a rule may use any
    built-in function or a Pandas UDF column (a model score, for example).
    """

    name: str
    points: Callable[[], Column]
    flag: Callable[[], Column]


def tiered(name: str, value: Callable[[], Column], tiers: Sequence[tuple[float, int, str]]) -> Rule:
    """A rule that takes the first tier whose floor ``value`` reaches."""

    def pick(of: Callable[[tuple], object], otherwise: Column) -> Column:
        out = None
        for tier in tiers:
            test = value() >= F.lit(tier[0])
            hit = F.lit(of(tier))
            out = F.when(test, hit) if out is None else out.when(test, hit)
        return otherwise if out is None else out.otherwise(otherwise)

    return Rule(
        name,
        lambda: pick(lambda t: t[1], F.lit(0)),
        lambda: pick(lambda t: t[2], F.lit(None).cast("string")),
    )


def when_true(name: str, test: Callable[[], Column], points: int, flag: str) -> Rule:
    def hit() -> Column:
        return F.coalesce(test(), F.lit(False))

    return Rule(
        name,
        lambda: F.when(hit(), F.lit(points)).otherwise(F.lit(0)),
        lambda: F.when(hit(), F.lit(flag)),
    )


def _amount() -> Column:
    # Spark orders NaN above every number; no tier may match it.
    return F.when(~F.isnan("amount"), F.col("amount"))


AMOUNT = tiered("amount", _amount, K.AMOUNT_TIERS)
CARD_VELOCITY = tiered("card_velocity", lambda: F.col("card_n"), K.CARD_TIERS)
IP_FANOUT = tiered("ip_fanout", lambda: F.col("ip_n"), K.IP_TIERS)
GEO = when_true(
    "geo_mismatch",
    lambda: F.col("issuer").isNotNull() & (F.col("issuer") != F.coalesce("country", F.lit(""))),
    K.GEO_POINTS,
    K.GEO_FLAG,
)
MCC = when_true("high_risk_mcc", lambda: F.col("mcc").isin(K.HIGH_RISK_MCC), K.MCC_POINTS, K.MCC_FLAG)

DEFAULT_RULES: tuple[Rule, ...] = (AMOUNT, CARD_VELOCITY, IP_FANOUT, GEO, MCC)


def total_points(rules: Sequence[Rule]) -> Column:
    total = F.lit(0)
    for rule in rules:
        total = total + F.greatest(rule.points(), F.lit(0))
    return total.cast("int")


_PASSED = "\u0000"  # stands for "no flag" until the array is built


def fired_flags(rules: Sequence[Rule]) -> Column:
    """Flags of the rules that gave points, in rule order.

    Built from ``array`` and ``array_remove``, which stay inside generated code.
    """
    if not rules:
        return F.array().cast("array<string>")
    named = [F.coalesce(F.when(rule.points() > 0, rule.flag()), F.lit(_PASSED)) for rule in rules]
    return F.array_remove(F.array(*named), _PASSED)


def decide(score: Column) -> Column:
    return (
        F.when(score >= K.DECLINE_SCORE, F.lit(K.DECLINE))
        .when(score >= K.REVIEW_SCORE, F.lit(K.REVIEW))
        .otherwise(F.lit(K.APPROVE))
    )


def apply_rules(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add ``score``, ``flags`` and ``decision``."""
    scored = df.withColumns({"score": total_points(rules), "flags": fired_flags(rules)})
    return scored.withColumn("decision", decide(F.col("score")))
