"""Fixed values that results depend on."""

# Decisions and their score floors.
APPROVE = "approve"
REVIEW = "review"
DECLINE = "decline"
REVIEW_SCORE = 40
DECLINE_SCORE = 70

# Case states and analyst labels.
OPEN = "open"
RESOLVED = "resolved"
CONFIRMED_FRAUD = "confirmed_fraud"
FALSE_POSITIVE = "false_positive"

# Velocity windows in milliseconds.
CARD_WINDOW_MS = 60_000
IP_WINDOW_MS = 300_000

# Rule tiers as (floor, points, flag), highest floor first.
AMOUNT_TIERS = [(5000.0, 45, "amount_extreme"), (1500.0, 20, "amount_high")]
CARD_TIERS = [(8, 50, "card_velocity_extreme"), (4, 25, "card_velocity")]
IP_TIERS = [(30, 40, "ip_fanout_extreme"), (12, 20, "ip_fanout")]
GEO_POINTS = 25
GEO_FLAG = "geo_mismatch"
MCC_POINTS = 15
MCC_FLAG = "high_risk_mcc"

# Issuer country per card BIN.
BIN_COUNTRY = {
    "411111": "US",
    "455673": "GB",
    "510510": "DE",
    "520082": "SE",
    "530127": "SE",
    "601100": "US",
    "356600": "JP",
    "627780": "BR",
    "506699": "NG",
}

# High-risk merchant categories.
HIGH_RISK_MCC = ["7995", "6051", "5967", "4829"]

# Latency bucket upper bounds in microseconds.
LATENCY_BOUNDS = [1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10_000, 100_000, 1_000_000]
QUANTILE_OVERFLOW = -1

# Sizes of the feed, the queue and the rate history.
FEED_SIZE = 64
APPROVAL_EVERY = 97
QUEUE_LIMIT = 50
QUEUE_CAP = 200
RATE_HISTORY = 90

# Topic names.
TX_TOPIC = "transactions"

# Metric names, in the order in which they are listed.
METRICS = [
    "transactions_scored_total",
    "decisions_total",
    "submissions_rejected_total",
    "rule_fires_total",
    "scoring_duration_microseconds_bucket",
    "scoring_duration_microseconds_sum",
    "scoring_duration_microseconds_count",
    "throughput_per_second",
    "kafka_consumer_lag",
    "kafka_consumer_lag_total",
]
