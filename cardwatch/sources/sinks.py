"""Writing transactions, verdicts, dead letters and the case table."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cardwatch import schemas
from cardwatch.operators.cases import apply_resolutions, open_cases
from cardwatch.session import remove, stage_at


def transaction_messages(tx: DataFrame) -> DataFrame:
    """Key and JSON value, keyed by card so that a card stays in one partition."""
    text = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    body = [text if n == "timestamp" else F.col(n) for n in schemas.TRANSACTION.fieldNames()]
    return tx.select(F.col("card_hash").alias("key"), F.to_json(F.struct(*body)).alias("value"))


def verdict_messages(verdicts: DataFrame) -> DataFrame:
    """Key and JSON value per verdict; an empty flag list is left out."""
    flags = F.when(F.size("flags") > 0, F.col("flags")).alias("flags")
    body = [flags if n == "flags" else F.col(n) for n in schemas.VERDICT_FIELDS]
    return verdicts.select(F.col("tx_id").alias("key"), F.to_json(F.struct(*body)).alias("value"))


def write_keyed(tx: DataFrame, path: str, partitions: int | None = None, time: str = "ts_ms") -> None:
    """Files in which a card's rows lie together and in time order.

    A card that outgrows a task is spread over time blocks of its own: the
    rows are range-partitioned by (card, time), so a file holds a run of cards
    or a run of one card's time, and never has to hold a whole card.
    """
    order = ["card_hash", time]
    spread = tx.repartitionByRange(partitions, *order) if partitions else tx.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def to_kafka(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Batch write to a topic (from a job or inside ``foreachBatch``)."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.compression.type", "snappy")
        .option("kafka.linger.ms", "5")
        .option("includeHeaders", "true")
        .options(**options)
        .save()
    )


MESSAGE_ID = "message-id"


def with_message_id(messages: DataFrame, run: str, batch: int) -> DataFrame:
    """Messages with a header that names them by run, micro-batch, content and, among equal ones, number.

    A micro-batch that is sent again gives its messages the same names, so a
    consumer can tell a repeat from a second message of the same content.
    """
    digest = F.md5(F.to_json(F.struct(*messages.columns)).cast("binary"))
    named = messages.withColumn("_digest", digest)
    number = F.row_number().over(Window.partitionBy("_digest").orderBy(F.lit(0)))
    name = F.concat_ws(":", F.lit(run), F.lit(str(batch)), "_digest", number.cast("string"))
    header = F.array(F.struct(F.lit(MESSAGE_ID).alias("key"), name.cast("binary").alias("value")))
    headers = F.concat("headers", header) if "headers" in messages.columns else header
    return named.withColumn("headers", headers).drop("_digest")


def received_once(messages: DataFrame) -> DataFrame:
    """Messages (with headers) of a topic that was written at least once, each once. Those without a name all stay."""
    mine = F.filter("headers", lambda h: h["key"] == MESSAGE_ID)
    named = messages.withColumn("_id", F.try_element_at(mine, F.lit(-1))["value"].cast("string"))
    rest = named.filter("_id IS NULL")
    return named.filter("_id IS NOT NULL").dropDuplicates(["_id"]).unionByName(rest).drop("_id")


def overwrite_part(df: DataFrame, path: str, run: str, batch: int) -> None:
    """Write one part of a table, named by the run and its micro-batch; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream's checkpoint: it lasts over restarts, and a fresh checkpoint has another."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


_COMMIT = "kind string, part string, base bigint"
_FIELDS = schemas.CASE.fieldNames()
_INDEX = "id string, bucket int"


class CaseTable:
    """Durable case table on files: a log of opened cases, a log of labels, and generations that they are folded into.

    A part of a log has a name its writer chooses, and counts once its commit
    exists: readers never see half a part, and a repeat of a committed part is
    known by its name and changes nothing. The two logs do not share names, so
    a stream and analysts write side by side.

    A generation holds the open cases, the resolved ones, and the ids of all in
    hash buckets, sorted. One commit names it and lists the parts that it holds,
    so it appears as a whole. ``add`` folds the logs into the next generation
    whenever ``fold_every`` parts have come, and reads the buckets its ids fall
    in and the parts since: the files it opens do not grow with the number of
    micro-batches. What a generation replaced goes with the one after it, so a
    read may last over one fold. One writer folds: the one that calls ``add``.
    """

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 32, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self.fold_every, self.buckets = fold_every, buckets

    def _read(self, schema, *paths: str) -> DataFrame:
        """The rows at some paths, none before anything was written there; any other fault is raised."""
        try:
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        return self._read(_COMMIT, f"{self.path}/commits/*")

    def _state(self) -> tuple[int, list[tuple[str, str]]]:
        """The newest generation, and the parts since: at most a fold's worth."""
        parts = self._commits().groupBy("kind", "part").agg(F.max("base").alias("base"))
        rows = parts.filter("base IS NULL OR kind = 'generation'").collect()
        return max((r.base for r in rows if r.kind == "generation"), default=-1), [(r.kind, r.part) for r in rows if r.kind != "generation"]

    def committed(self, kind: str, part: str | int) -> bool:
        return not self._commits().filter((F.col("kind") == kind) & (F.col("part") == str(part))).isEmpty()

    def _at(self, kind: str, part: str | int) -> str:
        return f"{self.path}/{kind}/part={quote(str(part), safe='')}"

    def _rows(self, kind: str, parts: list[tuple[str, str]]) -> DataFrame:
        return self._read(schemas.CASE, *[self._at(k, part) for k, part in parts if k == kind])

    def _held(self, status: str, base: int) -> DataFrame:
        return self._read(schemas.CASE, *([f"{self.path}/{status}-cases/generation={base}"] if base >= 0 else []))

    def _index(self, base: int) -> DataFrame:
        return self._read(_INDEX, *([f"{self.path}/ids/generation={base}"] if base >= 0 else []))

    def _bucket(self, column: str = "id"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _open(self, base: int, parts: list[tuple[str, str]]) -> DataFrame:
        done = self._rows("resolved", parts).select("id")
        return self._held("open", base).unionByName(self._rows("opened", parts)).join(done, "id", "left_anti").select(*_FIELDS)

    def open(self) -> DataFrame:
        return self._open(*self._state())

    def resolved(self) -> DataFrame:
        base, parts = self._state()
        return self._held("resolved", base).unionByName(self._rows("resolved", parts))

    def read(self) -> DataFrame:
        return self.open().unionByName(self.resolved())

    def known_ids(self, offered: DataFrame) -> DataFrame:
        """The ids of the table that can be among those of ``offered``, from the buckets they fall in."""
        return self._known_ids(offered, *self._state())

    def _known_ids(self, offered: DataFrame, base: int, parts: list[tuple[str, str]]) -> DataFrame:
        since = self._rows("opened", parts).select("id")
        if base < 0:
            return since
        # The set holds at most one number per bucket.
        mine, low, high = offered.agg(F.collect_set(self._bucket()), F.min("id"), F.max("id")).first()
        old = self._index(base).filter(F.col("bucket").isin(mine) & F.col("id").between(low, high))
        return old.select("id").unionByName(since)

    def _write(self, rows: DataFrame, kind: str, part: str | int) -> None:
        rows.write.mode("overwrite").parquet(self._at(kind, part))

    def _commit(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def _done(self, kind: str, part: str | int) -> None:
        one = self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(str(part)).alias("part"), F.lit(None).cast("bigint").alias("base"))
        self._commit(self._name(kind, part), one)

    def _name(self, kind: str, part: str | int) -> str:
        return f"{kind}-{quote(str(part), safe='')}"

    def add(self, part: str | int, verdicts: DataFrame, order=("at", "tx_id")) -> bool:
        """Open cases for the flagged verdicts whose id has none; False if this part is there already."""
        if self.committed("opened", part):
            return False
        # Written first, so that its size is known when its ids are matched: a
        # small batch is broadcast to the index.
        offered, path = stage_at(open_cases(verdicts, None, order), "offered")
        base, parts = self._state()
        again = self._known_ids(offered, base, parts).join(offered.select("id"), "id", "left_semi").distinct()
        self._write(offered.join(again, "id", "left_anti").select(*_FIELDS), "opened", part)
        self._done("opened", part)
        remove(self.spark, path)
        if len(parts) + 1 >= self.fold_every:
            self.compact()
        return True

    def label(self, part: str | int, resolutions: DataFrame) -> bool:
        """Apply analyst labels to the open cases; False if this part is there already."""
        if self.committed("resolved", part):
            return False
        self._write(apply_resolutions(self.open(), resolutions), "resolved", part)
        self._done("resolved", part)
        return True

    def compact(self) -> None:
        """Fold the parts since the last generation into the next one; ``add`` calls it."""
        old, parts = self._state()
        new = old + 1
        self._open(old, parts).write.mode("overwrite").parquet(f"{self.path}/open-cases/generation={new}")
        done = self._held("resolved", old).unionByName(self._rows("resolved", parts))
        done.write.mode("overwrite").parquet(f"{self.path}/resolved-cases/generation={new}")
        ids = self._index(old).unionByName(self._rows("opened", parts).select("id", self._bucket().alias("bucket")))
        ids.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/generation={new}")
        fresh = self.spark.createDataFrame([*parts, ("generation", str(new))], "kind string, part string")
        before = self._commits().filter((F.col("base") == old) & (F.col("kind") != "generation")).select("kind", "part")
        self._commit(f"generation-{new}", before.unionByName(fresh).withColumn("base", F.lit(new).cast("bigint")))
        self._clear(old)

    def _clear(self, generation: int) -> None:
        """Remove what ``generation`` replaced: the parts it holds and the generation before it."""
        commits = self._commits()
        listed = commits.filter(F.col("base") == generation).select("kind", "part")
        own = commits.filter("base IS NULL").select("kind", "part").join(listed, ["kind", "part"], "left_semi")
        for kind, part in own.distinct().collect():
            remove(self.spark, f"{self.path}/commits/{self._name(kind, part)}")
            remove(self.spark, self._at(kind, part))
        for name in ("open-cases", "resolved-cases", "ids"):
            remove(self.spark, f"{self.path}/{name}/generation={generation - 1}")
        remove(self.spark, f"{self.path}/commits/generation-{generation - 1}")


def status_partitioned(cases: DataFrame, path: str) -> None:
    """A snapshot of the case table, split by status for the queue and the label export."""
    cases.write.mode("overwrite").partitionBy("status").parquet(path)

