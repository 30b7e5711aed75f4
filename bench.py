"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the cores. ``rows_per_sec`` scores the transactions of the data, each
copied BENCH_COPIES times onto cards and addresses of its own, so that the
figure shows the engine and not the start of a job.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.operators.scoring import score, verdicts
from cardwatch.plans import fixture, streams
from cardwatch.plans.registry import QUERIES
from cardwatch.session import fresh_path, local_session, stage
from cardwatch.sources.records import file_records
from cardwatch.streaming.job import ScoringJob

HEADLINE = [
    "P8_verdicts",
    "A1_decision_counts",
    "A3_rule_fires",
    "A5_histogram_quantile",
    "A6_throughput_1s",
    "L1_review_queue",
    "L3_recent_feed",
    "C2_resolve_cases",
    "W1_card_velocity",
    "W2_ip_fanout",
    "S3_decode_tx",
    "S9_metrics_rows",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.time()
    fn()
    return round(time.time() - start, 3)


def copied(spark: SparkSession, d: str, copies: int) -> DataFrame:
    tx = fixture.transactions(spark, d).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    tag = F.concat(F.lit("_"), F.col("_copy"))
    return tx.select(
        *[
            F.concat(c, tag).alias(c)
            if c in ("id", "card_hash", "ip")
            else (F.col("seq") * copies + F.col("_copy")).alias("seq") if c == "seq" else F.col(c)
            for c in tx.columns
            if c != "_copy"
        ]
    )


def stream_rate(spark: SparkSession, d: str, copies: int, files: int) -> tuple[int, float]:
    """Rows and seconds of the whole scoring job over record files, every sink on."""
    records = fixture.records_of(copied(spark, d, copies), F.col("seq") % 6)
    source, files = streams.write_slices(records, F.unix_millis("timestamp"), "bench-records", least=files)
    base = fresh_path(spark, "bench")
    job = ScoringJob(
        checkpoint=f"{base}/checkpoint",
        verdict_path=f"{base}/verdicts",
        case_path=f"{base}/cases",
        dead_path=f"{base}/dead",
        snapshot_path=f"{base}/snapshot",
        buckets=64,
        wall_clock=False,
    )
    query = job.start(file_records(spark, source, max_files_per_trigger=files), availableNow=True)
    query.awaitTermination()
    # The first micro-batch also starts the workers; the others show the rate.
    steady = [p for p in query.recentProgress if p.numInputRows > 0][1:]
    rows = sum(p.numInputRows for p in steady)
    return rows, sum(p.durationMs["triggerExecution"] for p in steady) / 1000


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "20"))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    for name in HEADLINE[:2]:
        run(QUERIES[name](spark, d))
    took = {name: timed(lambda n=name: run(QUERIES[n](spark, d))) for name in HEADLINE}
    big = stage(copied(spark, d, copies).repartition(int(cpus)), "bench")
    rows = big.count()
    timed(lambda: run(verdicts(score(big))))
    batch = timed(lambda: run(verdicts(score(big))))
    stream_rows, stream_sec = stream_rate(spark, d, max(copies // 2, 1), int(cpus))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
                "rows_per_sec": {
                    "batch_scoring": round(rows / batch),
                    "stream_job_all_sinks": round(stream_rows / stream_sec) if stream_sec else None,
                },
                "batch_rows": rows,
            }
        )
    )
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
