"""Redelivery: messages whose delivery failed for a passing reason come back in later rounds.

Every micro-batch is a round: its messages and the pending ones that are due go through a sink in
one set-based pass, and leave in one write, split into delivered, pending and dead. The pending
rows of the last complete round are the retry table, so a round costs what arrived and what still
waits, however long the stream is. A round that died half-way is not seen and is repeated from the
round before it; a complete round that the stream plays again is skipped, so each message is
delivered once in the table. A sink with effects outside it sees a message again if it dies between
its effect and the end of the round, so those effects should be idempotent, as status folds are.

Defined results: messages that repeat an id are messages of their own; an empty batch redelivers
what is due; a null ``error`` means delivered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfdelta.session import children, remove

_STATE = "attempts int, next_at timestamp, last_error string"


class RetryTable:
    """``sink`` takes messages of ``schema`` with ``attempts`` (deliveries tried before) and returns them with
    ``error``, and optionally ``permanent`` (true: not worth another try).

    A message is dead after ``attempts`` failures; the wait after a failure doubles from ``wait_seconds``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame], DataFrame],
                 attempts: int = 5, wait_seconds: float = 30.0, now: Callable[[], Column] = F.current_timestamp):
        self.spark, self.folder, self.schema, self.sink = spark, folder, schema, sink
        self.attempts, self.wait_seconds, self.now = attempts, wait_seconds, now

    def _done(self) -> list[str]:
        return sorted(children(self.spark, f"{self.folder}/done"))

    def _rows(self, spark: SparkSession, kind: str, path: str = "rounds") -> DataFrame:
        fields = f"{self.schema}, {_STATE}"
        done = self._done()
        if not done:
            return spark.createDataFrame([], fields)
        rows = spark.read.schema(f"{fields}, round string, kind string").option("basePath", f"{self.folder}/rounds").parquet(f"{self.folder}/{path}")
        # A round that is running or died half-way lies beyond the last complete one.
        return rows.where((F.col("kind") == kind) & (F.col("round") <= done[-1])).drop("round", "kind")

    def _forget_broken(self) -> None:
        done = set(self._done())
        names = [n.removeprefix("round=") for n in children(self.spark, f"{self.folder}/rounds") if n.startswith("round=")]
        remove(self.spark, [f"{self.folder}/rounds/round={n}" for n in names if n not in done])

    def _run(self, name: str, spark: SparkSession, arrived: DataFrame | None) -> None:
        self._forget_broken()
        waiting, now = self.pending(spark), self.now()
        is_due = F.coalesce(F.col("next_at") <= now, F.lit(True))
        due = waiting.where(is_due)
        if arrived is not None:
            new = arrived.withColumns({"attempts": F.lit(0), "next_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})
            due = due.unionByName(new.select(*due.columns))
        tried = self.sink(due)
        permanent = F.coalesce(F.col("permanent"), F.lit(False)) if "permanent" in tried.columns else F.lit(False)
        failed, count = F.col("error").isNotNull(), F.col("attempts") + 1
        kind = F.when(~failed, "delivered").when(permanent | (count >= self.attempts), "dead").otherwise("pending")
        pause = F.make_dt_interval(secs=F.lit(self.wait_seconds).cast("decimal(18,6)") * F.pow(F.lit(2), F.col("attempts")).cast("decimal(18,0)"))
        own = [c for c in due.columns if c not in ("attempts", "next_at", "last_error")]
        out = tried.select(*own, count.cast("int").alias("attempts"), F.when(kind == "pending", now + pause).alias("next_at"),
                           F.coalesce("error", "last_error").alias("last_error"), kind.alias("kind"))
        out = out.unionByName(waiting.where(~is_due).withColumn("kind", F.lit("pending")))
        out.write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/rounds/round={name}")
        spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/done/{name}")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One round: the messages of a micro-batch and what is due."""
        name = f"r{batch_id:012d}_{0:06d}"
        if name not in self._done():
            self._run(name, batch.sparkSession, batch)

    def redeliver(self) -> bool:
        """A round without new messages, between batches or after them; returns whether any message still waits."""
        done = self._done()
        if not done:
            return False
        batch, n = done[-1].split("_")
        self._run(f"{batch}_{int(n) + 1:06d}", self.spark, None)
        return not self.pending().isEmpty()

    def start(self, messages: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Deliver a stream of messages of ``schema``."""
        writer = messages.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def pending(self, spark: SparkSession | None = None) -> DataFrame:
        """The retry table: messages, attempts, next_at, last_error. Reads the last complete round alone."""
        done = self._done()
        return self._rows(spark or self.spark, "pending", f"rounds/round={done[-1]}" if done else "rounds")

    def delivered(self) -> DataFrame:
        """Every delivered message once, with the attempts it took and its last error."""
        return self._rows(self.spark, "delivered")

    def dead(self) -> DataFrame:
        """The dead letters."""
        return self._rows(self.spark, "dead")

    def sweep(self, grace: int) -> int:
        """Remove the pending rows of rounds older than the last ``grace`` ones; delivered and dead rows stay."""
        old = [f"{self.folder}/rounds/round={n}/kind=pending" for n in self._done()[:-max(grace, 1)]]
        remove(self.spark, old)
        return len(old)


def known_tasks(tasks: Callable[[], DataFrame], key: str = "task_id", id_column: str = "id") -> Callable[[DataFrame], DataFrame]:
    """A sink: messages of tasks that are not there yet fail for now; those without a task id fail for good."""
    def sink(due: DataFrame) -> DataFrame:
        ids = tasks().select(F.col(id_column).alias("_known")).where("_known is not null").distinct()
        found = due.join(ids, F.col(key) == F.col("_known"), "left")
        return found.withColumn("permanent", F.col(key).isNull()).withColumn(
            "error", F.when(F.col(key).isNull(), "no task id").when(F.col("_known").isNull(), "unknown task")).drop("_known")
    return sink
