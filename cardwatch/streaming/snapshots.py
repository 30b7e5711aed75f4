"""Running totals of a stream as a log that folds itself.

Each micro-batch writes a small part: its counters, its verdicts per second and
its newest feed rows. Now and then the parts before the running micro-batch are
folded into a base, and a pointer says which base counts and up to which
micro-batch of each run it holds. A reader opens one base and the parts after
it, however long the stream has run. A part is named by run and micro-batch, so
a repeated micro-batch replaces its own; folded parts stay until the next fold,
for readers that came by the pointer before. One stream writes to a log at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import constants as K
from cardwatch import schemas
from cardwatch.operators import feed, rollups
from cardwatch.operators.histogram import bucket_of, from_counts, quantiles
from cardwatch.session import remove

#: Parts after which the log is folded.
FOLD_AFTER = 64

_TOTALS = "kind string, name string, n bigint"
_POINTER = "run string, upto bigint"
Parts = dict[str, list[int]]


def _totals(rows: DataFrame) -> DataFrame:
    """Counters of one micro-batch: (kind, name, n). A few rows per batch, and one per second in it."""
    extra = F.array(
        F.struct(F.lit("bucket").alias("kind"), bucket_of(F.col("latency_us")).cast("string").alias("name")),
        F.struct(F.lit("second").alias("kind"), F.floor(F.col("at") / 1000).cast("string").alias("name")),
    )
    return rollups.totals(rows, extra)


def _summed(totals: DataFrame) -> DataFrame:
    """The counters added up; of the seconds only those of the rate history stay."""
    added = totals.groupBy("kind", "name").agg(F.sum("n").cast("bigint").alias("n"))
    second = F.when(F.col("kind") == "second", F.col("name").cast("bigint"))
    newest = added.agg(F.max(second).alias("_newest"))  # one row
    kept = added.crossJoin(F.broadcast(newest)).filter(second.isNull() | (second > F.col("_newest") - K.RATE_HISTORY))
    return kept.drop("_newest")


class SnapshotLog:
    def __init__(self, spark: SparkSession, path: str, fold_after: int = FOLD_AFTER):
        self.spark = spark
        self.path = path.rstrip("/")
        self.fold_after = fold_after

    def _names(self, pattern: str) -> list[str]:
        """Folders of the log that match; their number is bounded by the folds."""
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = glob.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(glob)
        return [] if found is None else [f.getPath().toString() for f in found]

    def _parts(self) -> Parts:
        out: Parts = {}
        for name in self._names("parts/run=*/batch=*/totals"):
            run, batch = name.split("/")[-3:-1]
            out.setdefault(run.removeprefix("run="), []).append(int(batch.removeprefix("batch=")))
        return out

    def _generation(self) -> int:
        # A pointer is there once its one file is.
        return max((int(n.split("/")[-2].removeprefix("generation=")) for n in self._names("pointers/generation=*/part-*")), default=-1)

    def _pointer(self, generation: int) -> dict[str, int]:
        if generation < 0:
            return {}
        rows = self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointers/generation={generation}").collect()
        return {r.run: r.upto for r in rows}  # a row per run

    def _part(self, run: str, batch: int) -> str:
        return f"{self.path}/parts/run={run}/batch={batch}"

    def _base(self, generation: int) -> str:
        return f"{self.path}/base/generation={generation}"

    def write(self, rows: DataFrame, run: str, batch: int) -> None:
        """Add a micro-batch of verdicts, and fold what lies before it if that has grown long."""
        feed.recent(feed.feed_rows(rows, exact=False)).coalesce(1).write.mode("overwrite").parquet(f"{self._part(run, batch)}/recent")
        # The totals come last: a part counts once they are there. They meet in one task only after they were added up:
        # ``coalesce`` would add up all partitions of the shuffle in that task, each with a table of its own.
        _totals(rows).repartition(1).write.mode("overwrite").parquet(f"{self._part(run, batch)}/totals")
        held = self._pointer(self._generation())
        open_ = sum(b > held.get(r, -1) for r, own in self._parts().items() for b in own)
        if open_ > self.fold_after:
            self.fold(run, batch)

    def fold(self, run: str, batch: int) -> None:
        """Take all parts into the base but those of ``run`` from ``batch`` on, which can still be written again."""
        old = self._generation()
        held, parts = self._pointer(old), self._parts()
        taken = {r: [b for b in own if b > held.get(r, -1) and (r != run or b < batch)] for r, own in parts.items()}
        new = {r: max([held.get(r, -1), *taken.get(r, [])]) for r in {*held, *taken}}
        new = {r: upto for r, upto in new.items() if upto >= 0}
        if not any(taken.values()):
            return
        totals, recent = self._read(old, taken)
        totals.repartition(1).write.mode("overwrite").parquet(f"{self._base(old + 1)}/totals")
        recent.coalesce(1).write.mode("overwrite").parquet(f"{self._base(old + 1)}/recent")
        pointer = self.spark.createDataFrame(sorted(new.items()), _POINTER).coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{self.path}/pointers/generation={old + 1}")
        # Nobody who reads by this pointer or the one before needs what that one had folded.
        for r, own in parts.items():
            for b in own:
                if b <= held.get(r, -1):
                    remove(self.spark, self._part(r, b))
        for generation in range(max(0, old - 1), old):
            remove(self.spark, self._base(generation))
            remove(self.spark, f"{self.path}/pointers/generation={generation}")

    def _read(self, generation: int, parts: Parts) -> tuple[DataFrame, DataFrame]:
        folders = [self._part(r, b) for r, own in sorted(parts.items()) for b in sorted(own)]
        folders += [self._base(generation)] if generation >= 0 else []
        if not folders:
            return self.spark.createDataFrame([], _TOTALS), self.spark.createDataFrame([], schemas.VERDICT)
        totals = self.spark.read.schema(_TOTALS).parquet(*[f"{f}/totals" for f in folders])
        recent = self.spark.read.schema(schemas.VERDICT).parquet(*[f"{f}/recent" for f in folders])
        return _summed(totals), feed.recent(recent)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(kind, name, n) of all that was scored, and the recent feed."""
        generation = self._generation()
        held = self._pointer(generation)
        return self._read(generation, {r: [b for b in own if b > held.get(r, -1)] for r, own in self._parts().items()})


def rate_of(totals: DataFrame) -> DataFrame:
    """Verdicts in the newest second that is over: one row."""
    second = F.when(F.col("kind") == "second", F.col("name").cast("bigint"))
    newest = totals.agg(F.max(second).alias("_newest"))
    mine = F.when(second == F.col("_newest") - 1, F.col("n"))
    return totals.crossJoin(F.broadcast(newest)).agg(F.coalesce(F.sum(mine), F.lit(0)).cast("bigint").alias("rate_per_sec"))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stats row, recent feed) of all that was scored.

    The row holds the counters, rule fires, the p50 and p99 of the delay by
    bucket bound as the histogram gives them, and the rate of the newest second
    that is over.
    """
    totals, recent = SnapshotLog(spark, path).read()
    one = F.lit(1).alias("_one")
    fires = rollups.rule_fires_map(rollups.fires_of(totals)).select("*", one)
    stats = rollups.with_flagged_rate(rollups.counts_of(totals)).select("*", one)
    hist = from_counts(totals.filter("kind = 'bucket'").select(F.col("name").alias("bucket"), "n"))
    bound = lambda q: F.max(F.when(F.col("q") == q, F.col("bound")))
    delays = quantiles(hist, (0.5, 0.99)).agg(bound(0.5).alias("p50_us"), bound(0.99).alias("p99_us")).select("*", one)
    stats = stats.join(fires, "_one").join(delays, "_one").join(rate_of(totals).select("*", one), "_one").drop("_one")
    return stats, recent
