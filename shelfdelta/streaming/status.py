"""The status-message stream.

Every micro-batch appends its readable messages to a log and its unreadable ones to
a quarantine, in folders named after the batch id; a failed batch is retried from
the checkpoint and replaces its own folders. The task view folds the log over the
task table when it is read, so a batch never rewrites tasks and a message after a
terminal status has no effect, in whichever batch it comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfdelta.functions import fixed
from shelfdelta.operators import tasks as K
from shelfdelta.sources import messages as MS
from shelfdelta.streaming.levels import Levels


def start_log(raw: DataFrame, folder: str, body: str = "body", message_id: str | None = None,
              at: str | None = None, delay: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Log a stream of raw messages.

    With ``message_id`` and the event time ``at``, redelivered messages are dropped
    within ``delay``; later copies are harmless because the fold is idempotent.
    """
    if message_id and at:
        raw = raw.withWatermark(at, delay).dropDuplicatesWithinWatermark([message_id])

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = MS.parsed(batch, body)
        # One pass over the batch: both kinds go out of the same write.
        rows.withColumn("kind", F.when(F.col("problem").isNull(), "good").otherwise("quarantined")).withColumn(
            "place", F.monotonically_increasing_id()).write.mode("overwrite").partitionBy("kind").parquet(
            f"{folder}/log/batch={batch_id}")

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def logged(spark, folder: str, kind: str = "good") -> DataFrame:
    """The log so far. ``batch`` and ``place`` give the order of arrival."""
    return spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log").filter(F.col("kind") == kind)


def task_view(tasks: DataFrame, log: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The tasks as the logged messages leave them."""
    arrival = F.struct(*(order or [F.col("batch"), F.col("place")]))
    return K.apply_messages(tasks, log.withColumn("_seq", arrival), "_seq")


def _status_levels(spark, folder: str) -> Levels:
    return Levels(spark, f"{folder}/status-folds", K.FOLD, K.chained_folds)


def start_folds(raw: DataFrame, folder: str, body: str = "body", order: list[Column] | None = None, available_now: bool = True) -> StreamingQuery:
    """As ``start_log``, but of readable messages each batch keeps a fold by task, merged in levels; unreadable ones
    go to the quarantine. Inside a batch messages follow ``order`` (their arrival), batches follow each other."""
    def store(batch: DataFrame, batch_id: int) -> None:
        rows = MS.parsed(batch, body).withColumn("place", F.monotonically_increasing_id())
        rows.filter(F.col("problem").isNotNull()).write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
        good = rows.filter(F.col("problem").isNull()).withColumn("_seq", F.struct(*(order or [F.col("place")])))
        _status_levels(batch.sparkSession, folder).add(K.message_folds(good, "_seq"), batch_id)

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folded_view(tasks: DataFrame, folder: str) -> DataFrame:
    """The tasks as the folded batches leave them."""
    return K.apply_fold(tasks, _status_levels(tasks.sparkSession, folder).read())


def _lifecycle_levels(spark, folder: str) -> Levels:
    return Levels(spark, f"{folder}/folds", "task_id string, _f array<string>, _n bigint", lambda parts: K.chained(parts, "task_id"))


def start_lifecycle(messages: DataFrame, folder: str, order: str = "seq", available_now: bool = True) -> StreamingQuery:
    """Strict lifecycle of a stream of (task_id, status, ``order``): every micro-batch adds, per task,
    its messages composed into one fold, and folds are merged in levels. A repeated batch replaces itself."""
    def store(batch: DataFrame, batch_id: int) -> None:
        _lifecycle_levels(batch.sparkSession, folder).add(K.lifecycle_parts(batch, order), batch_id)

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def lifecycle_view(spark, folder: str) -> DataFrame:
    """(task_id, status, messages) as the batches so far leave every task."""
    return K.ended(_lifecycle_levels(spark, folder).read())


def progress_tail(lines: DataFrame, keep: int = fixed.PROGRESS_LINES) -> DataFrame:
    """The last progress lines per task, newest first, on read."""
    from shelfdelta.operators.paging import last_rows
    return last_rows(lines, "task_id", [F.col("ts").desc(), F.col("seq").desc()], keep)
