"""Built rows, and plain-Python models of the rules to test against."""

from __future__ import annotations

from cardwatch.schemas import VERDICT

TX = "id string, card_bin string, card_hash string, amount double, currency string, country string, ip string, merchant_id string, mcc string, ts_ms bigint, seq bigint"


def tx(i, **over):
    row = dict(
        id=f"tx_{i}", card_bin="510510", card_hash=f"card-{i}", amount=31.25, currency="EUR", country="DE",
        ip=f"172.16.{i // 200}.{i % 200}", merchant_id="shop", mcc="5943", ts_ms=1_700_000_000_000 + i, seq=i,
    )
    row.update(over)
    return row


def frame(spark, rows):
    names = [part.split()[0] for part in TX.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TX)


def arrival_counts(events, window_ms):
    """(key, ts) events in arrival order -> count per event, one at a time."""
    held, counts = {}, []
    for key, ts in events:
        held[key] = [t for t in held.get(key, []) if t >= ts - window_ms] + [ts]
        counts.append(len(held[key]))
    return counts


def verdict(i, score, at, decision=None, **over):
    decision = decision or ("decline" if score >= 70 else "review" if score >= 40 else "approve")
    row = dict(
        tx_id=i, card_bin="520082", amount=1.0, currency="SEK", country="SE", score=score, flags=[],
        decision=decision, latency_us=0, at=at, seq=at,
    )
    row.update(over)
    return row


def verdicts(spark, rows):
    names = [*VERDICT.fieldNames(), "seq"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VERDICT) + ", seq bigint"
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)
