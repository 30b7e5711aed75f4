"""The same answers in ANSI SQL, for an independent engine.

The velocity counts are written from the rule itself, as a count over a pair
condition, and share nothing with the window form of the Spark side.
"""

from __future__ import annotations

_TX = """
b AS (
  SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         1704067200000 + ((epoch_us(ts) // 1000 - 1704067200000) // 1440) AS ts_ms
  FROM events),
tx AS (
  SELECT 'tx_' || event_id AS id, event_id, user_id, k,
    (['411111','455673','510510','520082','530127','601100','356600','627780','506699','999999'])
      [CAST(user_id % 10 AS INT) + 1] AS card_bin,
    'tok_' || user_id AS card_hash, value * 20.0::DOUBLE AS amount, 'SEK' AS currency,
    CASE WHEN k % 10 = 0 THEN 'RU'
         ELSE (['US','GB','DE','SE','SE','US','JP','BR','NG','XX'])[CAST(user_id % 10 AS INT) + 1]
    END AS country,
    CASE WHEN k < 6 THEN '10.9.9.9'
         ELSE '10.' || (user_id % 7) || '.' || user_id || '.' || (event_id % 2) END AS ip,
    'shop-' || (event_id % 250) AS merchant_id,
    (['5942','7832','5541','5651','8062','7995','6051','4829'])[k % 8 + 1] AS mcc, ts_ms
  FROM b),
bins(bin, issuer) AS (VALUES ('411111','US'), ('455673','GB'), ('510510','DE'), ('520082','SE'),
  ('530127','SE'), ('601100','US'), ('356600','JP'), ('627780','BR'), ('506699','NG'))
"""

_VELOCITY = """,
card AS (
  SELECT a.event_id, count(*) AS card_n FROM tx a JOIN tx o ON o.card_hash = a.card_hash
    AND o.ts_ms BETWEEN a.ts_ms - 60000 AND a.ts_ms
    AND (o.ts_ms < a.ts_ms OR o.event_id <= a.event_id)
  GROUP BY a.event_id),
fan AS (
  SELECT a.event_id, count(*) AS ip_n FROM tx a JOIN tx o ON o.ip = a.ip
    AND o.ts_ms BETWEEN a.ts_ms - 300000 AND a.ts_ms
    AND (o.ts_ms < a.ts_ms OR o.event_id <= a.event_id)
  GROUP BY a.event_id)
"""

_VERDICTS = (
    _VELOCITY
    + """,
fired AS (
  SELECT t.*, card_n, ip_n,
    CASE WHEN amount >= 5000 THEN 'amount_extreme' WHEN amount >= 1500 THEN 'amount_high' END AS f1,
    CASE WHEN card_n >= 8 THEN 'card_velocity_extreme' WHEN card_n >= 4 THEN 'card_velocity' END AS f2,
    CASE WHEN ip_n >= 30 THEN 'ip_fanout_extreme' WHEN ip_n >= 12 THEN 'ip_fanout' END AS f3,
    CASE WHEN issuer IS NOT NULL AND issuer <> country THEN 'geo_mismatch' END AS f4,
    CASE WHEN mcc IN ('7995','6051','5967','4829') THEN 'high_risk_mcc' END AS f5
  FROM tx t JOIN card USING (event_id) JOIN fan USING (event_id) LEFT JOIN bins ON bin = card_bin),
points(flag, pts) AS (VALUES ('amount_extreme',45), ('amount_high',20), ('card_velocity_extreme',50),
  ('card_velocity',25), ('ip_fanout_extreme',40), ('ip_fanout',20), ('geo_mismatch',25), ('high_risk_mcc',15)),
scored AS (
  SELECT *, CAST((SELECT coalesce(sum(pts), 0) FROM points WHERE flag IN (f1, f2, f3, f4, f5)) AS INT) AS score,
    concat_ws(',', f1, f2, f3, f4, f5) AS flags FROM fired),
v AS (
  SELECT id AS tx_id, event_id, card_hash, card_bin, amount, currency, country, score, flags, ts_ms AS "at",
    CASE WHEN score >= 70 THEN 'decline' WHEN score >= 40 THEN 'review' ELSE 'approve' END AS decision
  FROM scored),
hot AS (SELECT * FROM v WHERE decision <> 'approve'),
fires AS (
  SELECT rule, count(*) AS fires FROM (
    SELECT unnest([f1, f2, f3, f4, f5]) AS rule FROM fired) WHERE rule IS NOT NULL GROUP BY rule)
"""
)

_RESOLUTIONS = """,
res AS (
  SELECT tx_id AS id, "at" + 90000 + again * 1000 AS resolved_at, event_id * 2 + again AS seq,
    CASE WHEN event_id % 5 = 0 THEN 'maybe' WHEN score >= 70 THEN 'confirmed_fraud'
         ELSE 'false_positive' END AS resolution
  FROM hot, (VALUES (0), (1)) AS r(again)
  WHERE event_id % 3 = 0 AND (again = 0 OR event_id % 6 = 0)),
firsts AS (
  SELECT id, min_by(resolution, seq) AS resolution, min_by(resolved_at, seq) AS resolved_at, min(seq) AS seq
  FROM res WHERE resolution <> 'maybe' GROUP BY id),
cases AS (
  SELECT tx_id AS id, score, CASE WHEN f.id IS NULL THEN 'open' ELSE 'resolved' END AS status,
    f.resolution, "at" AS opened_at, f.resolved_at
  FROM hot LEFT JOIN firsts f ON f.id = tx_id)
"""

_SECONDS = """,
sec AS (SELECT ts_ms // 1000 AS second, count(*) AS c FROM tx GROUP BY 1),
series AS (
  SELECT s.second, coalesce(c, 0) AS n
  FROM (SELECT unnest(generate_series((SELECT min(second) FROM sec), (SELECT max(second) FROM sec))) AS second) s
  LEFT JOIN sec USING (second))
"""

_BUCKETS = """,
us AS (SELECT CAST(trunc(amount * 100) AS BIGINT) AS us FROM tx),
bounds(bucket, le) AS (VALUES (0,1), (1,2), (2,5), (3,10), (4,25), (5,50), (6,100), (7,250), (8,500),
  (9,1000), (10,2500), (11,5000), (12,10000), (13,100000), (14,1000000), (15,NULL)),
hist AS (
  SELECT CAST(bucket AS INT) AS bucket, CAST(le AS BIGINT) AS le,
    (SELECT count(*) FROM us WHERE le IS NULL OR us <= le) AS cum_count,
    (SELECT CAST(sum(us) AS BIGINT) FROM us) AS sum, (SELECT count(*) FROM us) AS count
  FROM bounds)
"""

_LAG = """,
obs AS (
  SELECT CAST(user_id % 6 AS INT) AS partition, event_id AS seq, event_id + user_id % 50 AS hwm,
    CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id - 1 END AS off FROM events),
pos AS (
  SELECT partition, seq, hwm, max(CASE WHEN off >= 0 THEN seq END) OVER (
    PARTITION BY partition ORDER BY seq) AS read_seq FROM obs),
lags AS (
  SELECT p.partition, CAST(greatest(p.hwm - o.off - 1, 0) AS BIGINT) AS lag
  FROM pos p JOIN obs o ON o.partition = p.partition AND o.seq = p.read_seq
  WHERE p.seq = (SELECT max(seq) FROM pos m WHERE m.partition = p.partition))
"""

# Broken records and the cause each one gets.
_CAUSES = (
    "(['invalid JSON','empty record','not a JSON object','id is not a string','invalid JSON',"
    "'more than one JSON document','amount is not a number','invalid JSON','timestamp is not RFC 3339'])"
)

_BROKEN = (
    """(['{not json','','[<json>]','{"id":5}','<json> x','<json>,<json>','{"amount":"12"}','{"amount":NaN}',"""
    """'{"timestamp":"2024-01-01 00:00:00"}'])"""
)
_JSON = (
    "'{' || " + " || ',' || ".join(
        f"""'"{n}":"' || {n} || '"'""" if n != "amount" else """'"amount":' || amount"""
        for n in "id card_bin card_hash amount currency country ip merchant_id mcc".split()
    ) + """ || ',"timestamp":"' || strftime(make_timestamp_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') || '"}'"""
)


def _tx(body: str) -> str:
    return f"WITH {_TX} {body}"


def _vel(body: str) -> str:
    return f"WITH {_TX}{_VELOCITY} {body}"


def _ver(body: str, more: str = "") -> str:
    return f"WITH {_TX}{_VERDICTS}{more} {body}"


def _case(body: str) -> str:
    return _ver(body, _RESOLUTIONS)


_COUNTS = (
    "count(*) AS processed, count(*) FILTER (decision = 'approve') AS approved, "
    "count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (decision = 'decline') AS declined"
)
_FLAT = "id, score, status, resolution, opened_at, resolved_at"
_CASE_COUNTS = (
    "SELECT count(*) FILTER (status = 'open') AS open, "
    "count(*) FILTER (resolution = 'confirmed_fraud') AS confirmed_fraud, "
    "count(*) FILTER (resolution = 'false_positive') AS false_positive FROM cases"
)
# Position of an arrival in the late-run order: slices 1, 2, then 0.
_BITS = "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), "
    f"lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), {_BITS})))"
)


def _left(key: str, window: int) -> str:
    """Keys of a rule with an event in a block of time that is not over for the newest event of their bucket."""
    return (
        f"SELECT DISTINCT '{key}' AS rule, CAST(bucket AS INT) AS bucket, key FROM (SELECT key, bucket, ts_ms, max(ts_ms) OVER (PARTITION BY bucket) AS newest FROM "
        f"(SELECT {key} AS key, {_CRC32.format(key)} % 32 AS bucket, ts_ms FROM tx)) WHERE (ts_ms // {window} + 1) * {window} > newest - {window}"
    )


_LATE = """,
arr AS (
  SELECT *, CASE slice WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS turn FROM (
    SELECT *, least((ts_ms - 1704067200000) // 600000, 2) AS slice FROM tx))
"""


def _late_count(key: str, window: int, name: str) -> str:
    """Arrival-order count, from the rule: an earlier arrival is still held unless an
    arrival after it (up to the row itself) was more than a window newer."""
    return f""",
{name}_top AS (SELECT {key}, turn, max(ts_ms) AS top FROM arr GROUP BY ALL),
{name} AS (
  SELECT a.event_id, count(*) AS n FROM arr a JOIN arr o ON o.{key} = a.{key}
    AND (o.turn < a.turn OR (o.turn = a.turn AND (o.ts_ms < a.ts_ms OR (o.ts_ms = a.ts_ms AND o.event_id <= a.event_id))))
    AND o.ts_ms >= a.ts_ms - {window}
  WHERE NOT EXISTS (SELECT 1 FROM {name}_top t WHERE t.{key} = a.{key} AND t.turn >= o.turn AND t.turn < a.turn
    AND o.ts_ms < t.top - {window})
  GROUP BY a.event_id)
"""


ORACLES: dict[str, str] = {
    "P1_rule_amount": _tx(
        "SELECT id, CAST(CASE WHEN amount >= 5000 THEN 45 WHEN amount >= 1500 THEN 20 ELSE 0 END AS INT) AS points, "
        "CASE WHEN amount >= 5000 THEN 'amount_extreme' WHEN amount >= 1500 THEN 'amount_high' END AS flag FROM tx"
    ),
    "P2_rule_geo": _tx(
        "SELECT id, CAST(CASE WHEN issuer <> country THEN 25 ELSE 0 END AS INT) AS points, "
        "CASE WHEN issuer <> country THEN 'geo_mismatch' END AS flag FROM tx LEFT JOIN bins ON bin = card_bin"
    ),
    "P3_rule_mcc": _tx(
        "SELECT id, CAST(CASE WHEN mcc IN ('7995','6051','5967','4829') THEN 15 ELSE 0 END AS INT) AS points, "
        "CASE WHEN mcc IN ('7995','6051','5967','4829') THEN 'high_risk_mcc' END AS flag FROM tx"
    ),
    "J1_bin_issuer_join": _tx("SELECT id, card_bin, issuer FROM tx LEFT JOIN bins ON bin = card_bin"),
    "J2_mcc_exists": _tx(
        "SELECT id, mcc FROM tx WHERE EXISTS (SELECT 1 FROM (VALUES ('7995'),('6051'),('5967'),('4829')) m(c) "
        "WHERE c = mcc)"
    ),
    "W1_card_velocity": _vel("SELECT id, card_n FROM tx JOIN card USING (event_id)"),
    "W2_ip_fanout": _vel("SELECT id, ip_n FROM tx JOIN fan USING (event_id)"),
    "P4_P5_velocity_points": _vel(
        "SELECT id, CAST(CASE WHEN card_n >= 8 THEN 50 WHEN card_n >= 4 THEN 25 ELSE 0 END AS INT) AS card_points, "
        "CASE WHEN card_n >= 8 THEN 'card_velocity_extreme' WHEN card_n >= 4 THEN 'card_velocity' END AS card_flag, "
        "CAST(CASE WHEN ip_n >= 30 THEN 40 WHEN ip_n >= 12 THEN 20 ELSE 0 END AS INT) AS ip_points, "
        "CASE WHEN ip_n >= 30 THEN 'ip_fanout_extreme' WHEN ip_n >= 12 THEN 'ip_fanout' END AS ip_flag "
        "FROM tx JOIN card USING (event_id) JOIN fan USING (event_id)"
    ),
    "P6_score_flags": _ver(
        "SELECT tx_id, score, CASE WHEN flags = '' THEN 'clean' ELSE replace(flags, ',', ', ') END AS flags FROM v"
    ),
    "U1_own_rules": _ver(
        "SELECT tx_id, s AS score, CASE WHEN s >= 70 THEN 'decline' WHEN s >= 40 THEN 'review' ELSE 'approve' END AS decision, "
        "amount >= 1000 AS modelled FROM (SELECT *, CAST(score + CASE WHEN amount >= 1000 THEN 7 ELSE 0 END AS INT) AS s FROM v)"
    ),
    "S6_keyed_files": _tx("SELECT id, card_hash, amount, ts_ms FROM tx"),
    "P7_decide": _ver("SELECT tx_id, decision FROM v"),
    "P8_verdicts": _ver(
        "SELECT tx_id, card_bin, amount, currency, country, score, flags, decision, "
        "CAST(0 AS BIGINT) AS latency_us, \"at\" FROM v"
    ),
    "P9_flagged": _ver("SELECT tx_id, score, decision FROM hot"),
    "P10_to_millis": _tx("SELECT id, ts_ms FROM tx"),
    "P11_valid_resolution": _case(
        "SELECT id, seq, resolution IN ('confirmed_fraud', 'false_positive') AS valid FROM res"
    ),
    "P13_run_prefix_filter": _ver("SELECT tx_id FROM v WHERE tx_id LIKE 'tx\\_1%' ESCAPE '\\'"),
    "A1_decision_counts": _ver(f"SELECT {_COUNTS} FROM v"),
    "A2_flagged_rate": _ver(
        "SELECT count(*) AS processed, CAST(count(*) FILTER (decision <> 'approve') AS DOUBLE) / count(*) "
        "AS flagged_rate FROM v"
    ),
    "A3_rule_fires": _ver("SELECT rule, fires FROM fires"),
    "A4_latency_histogram": _tx(f"{_BUCKETS} SELECT * FROM hist"),
    "W3_cumulative_buckets": _tx(
        f"{_BUCKETS} SELECT bucket, n, cum_count FROM (SELECT bucket, cum_count, "
        "cum_count - coalesce(lag(cum_count) OVER (ORDER BY bucket), 0) AS n FROM hist) WHERE n > 0"
    ),
    "A5_histogram_quantile": _tx(
        f"{_BUCKETS} SELECT q, (SELECT coalesce(h.le, -1) FROM hist h WHERE h.cum_count >= h.count * q "
        "ORDER BY h.bucket LIMIT 1) AS bound FROM (SELECT unnest([0.0, 0.1, 0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS q)"
    ),
    "A6_throughput_1s": _tx(f"{_SECONDS} SELECT second, n FROM series"),
    "W5_rate_delta": _tx(
        f"{_SECONDS} SELECT second, CAST(sum(n) OVER (ORDER BY second) AS BIGINT) AS processed, n AS rate FROM series"
    ),
    "W8_rate_history": _tx(f"{_SECONDS} SELECT second, n FROM series ORDER BY second DESC LIMIT 90"),
    "A9_decision_share": _ver(
        "SELECT d AS decision, count(decision) AS n, CAST(count(decision) AS DOUBLE) / (SELECT count(*) FROM v) * 100 "
        "AS pct FROM (VALUES ('approve'), ('review'), ('decline')) k(d) LEFT JOIN v ON decision = d GROUP BY d"
    ),
    "A10_rule_share_of_max": _ver(
        "SELECT rule, fires, CAST(fires AS DOUBLE) / (SELECT max(fires) FROM fires) AS share FROM fires"
    ),
    "L4_top_rules": _ver("SELECT rule, fires FROM fires ORDER BY fires DESC, rule"),
    "S9_metrics_rows": _ver(
        f"""{_SECONDS}{_BUCKETS}{_LAG}
SELECT 'transactions_scored_total' AS metric, 'counter' AS type, '' AS label, count(*) AS value FROM v
UNION ALL SELECT 'decisions_total', 'counter', '{{decision="' || d || '"}}', count(decision)
  FROM (VALUES ('approve'), ('review'), ('decline')) k(d) LEFT JOIN v ON decision = d GROUP BY d
UNION ALL SELECT 'submissions_rejected_total', 'counter', '', 0
UNION ALL SELECT 'rule_fires_total', 'counter', '{{rule="' || rule || '"}}', fires FROM fires
UNION ALL SELECT 'scoring_duration_microseconds_bucket', 'histogram',
  '{{le="' || coalesce(CAST(le AS VARCHAR), '+Inf') || '"}}', cum_count FROM hist
UNION ALL SELECT 'scoring_duration_microseconds_sum', 'histogram', '', sum FROM hist WHERE le IS NULL
UNION ALL SELECT 'scoring_duration_microseconds_count', 'histogram', '', count FROM hist WHERE le IS NULL
UNION ALL SELECT 'throughput_per_second', 'gauge', '', n FROM series WHERE second = (SELECT max(second) FROM series)
UNION ALL SELECT 'kafka_consumer_lag', 'gauge', '{{partition="' || partition || '"}}', lag FROM lags
UNION ALL SELECT 'kafka_consumer_lag_total', 'gauge', '', CAST(sum(lag) AS BIGINT) FROM lags"""
    ),
    "W6_first_verdict_wins": _ver("SELECT tx_id, \"at\", score FROM hot WHERE event_id % 11 <> 0"),
    "J3_open_new_cases": _ver("SELECT tx_id AS id, score, \"at\" AS opened_at FROM hot WHERE event_id % 2 <> 0"),
    "C1_open_cases": _ver(
        "SELECT tx_id AS id, score, 'open' AS status, CAST(NULL AS VARCHAR) AS resolution, \"at\" AS opened_at, "
        "CAST(NULL AS BIGINT) AS resolved_at FROM hot"
    ),
    "J4_apply_resolutions": _case("SELECT id, resolution, resolved_at FROM firsts"),
    "J4_rejected_resolutions": _case(
        "SELECT r.id, r.seq, CASE WHEN resolution = 'maybe' THEN 'invalid_resolution' "
        "ELSE 'not_found_or_already_resolved' END AS reason FROM res r "
        "WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.id = r.id AND f.seq = r.seq AND (r.seq // 2) % 9 <> 0)"
    ),
    "C2_resolve_cases": _case(f"SELECT {_FLAT} FROM cases"),
    "A8_case_counts": _case(_CASE_COUNTS),
    "C3_count_cases": _case(_CASE_COUNTS),
    "P12_case_status_filter": _case(f"SELECT {_FLAT} FROM cases WHERE status = 'open'"),
    "L1_review_queue": _case(
        f"SELECT {_FLAT} FROM cases WHERE status = 'open' ORDER BY score DESC, opened_at DESC, id LIMIT 50"
    ),
    "L2_resolved_history": _case(
        f"SELECT {_FLAT} FROM cases WHERE status = 'resolved' ORDER BY resolved_at DESC, id LIMIT 50"
    ),
    "L5_queue_cap": _case(f"SELECT {_FLAT} FROM cases WHERE status = 'open' ORDER BY opened_at DESC, id LIMIT 200"),
    "L6_history_cap": _case(
        f"SELECT {_FLAT} FROM cases WHERE status = 'resolved' ORDER BY resolved_at DESC, id LIMIT 200"
    ),
    "J5_queue_diff": _case(
        "SELECT count(*) AS new_cases FROM "
        "(SELECT id FROM cases WHERE status = 'open' ORDER BY opened_at DESC, id LIMIT 200) WHERE id NOT IN "
        "(SELECT id FROM cases WHERE status = 'open' AND opened_at % 5 <> 0 ORDER BY opened_at DESC, id LIMIT 200)"
    ),
    "C5_label_export": _case(
        "SELECT c.resolution, tx_id, card_bin, amount, currency, country, h.score, flags, decision, "
        "CAST(0 AS BIGINT) AS latency_us, \"at\" FROM cases c JOIN hot h ON tx_id = id WHERE status = 'resolved'"
    ),
    "S8_case_table": _case(f"SELECT {_FLAT} FROM cases"),
    "S8_labels_beside_stream": _case(f"SELECT {_FLAT} FROM cases"),
    "W7_approval_sample": _ver(
        "SELECT tx_id, processed_no FROM (SELECT *, row_number() OVER (ORDER BY \"at\", event_id) AS processed_no FROM v) "
        "WHERE decision = 'approve' AND processed_no % 97 = 0"
    ),
    "W7_approval_sample_by_id": _ver(
        "SELECT tx_id FROM v WHERE decision = 'approve' AND CAST('0x' || substr(md5(tx_id), 1, 8) AS BIGINT) % 97 = 0"
    ),
    "L3_recent_feed": _ver(
        "SELECT tx_id, score, decision, \"at\", CASE WHEN flags = '' THEN 'clean' ELSE replace(flags, ',', ', ') END "
        "AS flags FROM (SELECT *, row_number() OVER (ORDER BY \"at\", event_id) AS no FROM v) "
        "WHERE decision <> 'approve' OR no % 97 = 0 ORDER BY \"at\" DESC, event_id DESC LIMIT 64"
    ),
    "J6_missing_verdicts": _ver("SELECT tx_id FROM hot WHERE event_id % 11 = 0"),
    "A12_delivery_audit": _ver(
        "SELECT CAST(sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS delivered, "
        "count(*) AS distinct_ids, count(*) FILTER (event_id % 7 = 0) AS duplicated_ids FROM hot WHERE event_id % 11 <> 0"
    ),
    "A13_window_loss_audit": _vel(
        "SELECT count(*) FILTER (m < 8) AS lost, count(*) FILTER (m >= 8) AS kept FROM "
        "(SELECT max(card_n) AS m FROM tx JOIN card USING (event_id) GROUP BY card_hash)"
    ),
    "A11_ingest_accounting": _tx(
        ", s AS (SELECT event_id % 50 = 0 AS bad, k % 20 AS shed FROM tx), "
        "t AS (SELECT CAST(sum(CASE WHEN bad THEN 0 ELSE 100 - shed END) AS BIGINT) AS accepted, "
        "CAST(sum(CASE WHEN bad THEN 100 ELSE 0 END) AS BIGINT) AS failed, "
        "CAST(sum(CASE WHEN bad THEN 0 ELSE shed END) AS BIGINT) AS shed FROM s) "
        "SELECT accepted, failed, shed, accepted / 10.0::DOUBLE AS achieved_rate, "
        "CAST(shed AS DOUBLE) / (accepted + shed) * 100 AS shed_pct, "
        "accepted / 10.0::DOUBLE < 1000000 * 0.95::DOUBLE AS missed_target FROM t"
    ),
    "W4_partition_lag": _tx(f"{_LAG} SELECT partition, lag FROM lags"),
    "A7_lag_total": _tx(f"{_LAG} SELECT CAST(sum(lag) AS BIGINT) AS lag_total FROM lags"),
    "S3_decode_tx": _tx(
        ", good AS (SELECT * FROM tx) SELECT id, card_bin, card_hash, amount, currency, country, ip, merchant_id, mcc, "
        "ts_ms FROM good"
    ),
    "S4_dlq_split": _tx(
        "SELECT card_hash AS key, 'cause=' || "
        f"{_CAUSES}[CAST((event_id // 40) % 9 AS INT) + 1] || ';origin-topic=transactions;origin-partition=' || "
        "(user_id % 6) || ';origin-offset=' || (event_id * 2 + 1) AS headers, "
        f"replace({_BROKEN}[CAST((event_id // 40) % 9 AS INT) + 1], '<json>', {_JSON}) AS value FROM tx WHERE event_id % 40 = 0"
    ),
    "S5_write_verdicts": _ver("SELECT tx_id AS key, tx_id, score, flags, \"at\" FROM hot"),
    "S6_write_tx_keyed": _tx("SELECT card_hash AS key, id FROM tx"),
    "S2_read_tx_batch": _tx("SELECT id, amount, ts_ms FROM tx WHERE (event_id // 100) % 9 <> 4"),
    "T1_stream_velocity": _vel(
        "SELECT id, card_n, ip_n FROM tx JOIN card USING (event_id) JOIN fan USING (event_id)"
    ),
    "T2_state_expiry": _vel(
        "SELECT id, card_n, ip_n FROM tx JOIN card USING (event_id) JOIN fan USING (event_id)"
    ),
    "T2_keys_left": _tx(f"{_left('card_hash', 60000)} UNION ALL {_left('ip', 300000)}"),
    "T4_commit_after_score": _ver(
        "SELECT count(*) AS delivered, count(DISTINCT tx_id) AS distinct_ids, CAST(0 AS BIGINT) AS duplicated_ids FROM hot"
    ),
    "T3_late_events": _tx(
        f"{_LATE}{_late_count('card_hash', 60000, 'late_card')}{_late_count('ip', 300000, 'late_ip')}"
        "SELECT id, c.n AS card_n, i.n AS ip_n FROM tx JOIN late_card c USING (event_id) JOIN late_ip i USING (event_id)"
    ),
    "T5_verdict_dedupe": _ver("SELECT tx_id, score, \"at\" FROM hot"),
    "T6_state_survives_restart": _vel(
        ", late AS (SELECT card_hash, max(card_n) AS m FROM tx JOIN card USING (event_id) "
        "WHERE least((ts_ms - 1704067200000) // 600000, 2) = 2 GROUP BY card_hash) "
        "SELECT CAST(0 AS BIGINT) AS lost, count(*) AS kept FROM late WHERE m >= 8"
    ),
    "T7_stream_throughput": _tx("SELECT ts_ms // 1000 AS second, count(*) AS n FROM tx GROUP BY 1"),
    "T8_stream_snapshot": _ver(
        "SELECT count(*) AS processed, count(*) FILTER (decision = 'approve') AS approved, "
        "count(*) FILTER (decision = 'review') AS reviewed, count(*) FILTER (decision = 'decline') AS declined, "
        "CAST(count(*) FILTER (decision <> 'approve') AS DOUBLE) / count(*) AS flagged_rate, "
        "count(*) FILTER (decision <> 'approve') AS open, CAST(1 AS BIGINT) AS p50_us, CAST(1 AS BIGINT) AS p99_us, "
        "(SELECT count(*) FROM v WHERE \"at\" // 1000 = (SELECT max(\"at\") // 1000 - 1 FROM v)) AS rate_per_sec, "
        "(SELECT string_agg(rule || '=' || fires, ',' ORDER BY rule) FROM fires) AS rule_fires FROM v"
    ),
    "T9_stream_lag": _tx(
        ", r AS (SELECT CAST(user_id % 6 AS INT) AS partition, event_id * 2 AS o, max(event_id * 2) OVER () * 2 // 3 AS cut FROM tx), "
        "h AS (SELECT partition, max(o) FILTER (o < cut) + 1 AS early, max(o) + 1 AS head FROM r GROUP BY 1), "
        "e AS (SELECT *, CASE WHEN sum(early) OVER () <= 50000 THEN early "
        "ELSE (early * 50000 + sum(early) OVER () - 1) // sum(early) OVER () END AS one FROM h), "
        "f AS (SELECT *, CASE WHEN sum(head - one) OVER () <= 50000 THEN head "
        "ELSE one + ((head - one) * 50000 + sum(head - one) OVER () - 1) // sum(head - one) OVER () END AS two FROM e) "
        "SELECT partition, CAST(head - two AS BIGINT) AS lag, CAST(sum(head - two) OVER () AS BIGINT) AS lag_total FROM f"
    ),
    "S1_read_tx_stream": _tx(
        ", r AS (SELECT user_id % 6 AS p, event_id * 2 AS o FROM tx UNION ALL "
        "SELECT user_id % 6, event_id * 2 + 1 FROM tx WHERE event_id % 40 = 0) "
        "SELECT 'transactions' AS topic, CAST(p AS INT) AS partition, count(*) AS n, count(DISTINCT o) AS offsets, "
        'min(o) AS first, max(o) AS "last", max(o) + 1 AS high_watermark FROM r GROUP BY p'
    ),
    "S2_ingest_bodies": _tx(
        "SELECT event_id // 100 AS body_no, CASE WHEN event_id // 100 % 9 = 4 THEN 0 ELSE count(*) END AS n, "
        "CAST(CASE WHEN event_id // 100 % 9 = 4 THEN 0 ELSE sum(ts_ms) END AS BIGINT) AS times, "
        "CASE WHEN event_id // 100 % 9 = 4 THEN 'id is not a string' ELSE '' END AS cause FROM tx GROUP BY 1"
    ),
    "S7_topics_once": _ver(
        "SELECT 'verdicts' AS topic, count(*) AS n, true AS repeated FROM hot UNION ALL "
        "SELECT 'dead', count(*) FILTER (event_id % 40 = 0), true FROM tx"
    ),
    "S1_S7_scoring_job": _ver("SELECT tx_id, score, flags, decision, \"at\" FROM hot"),
}
