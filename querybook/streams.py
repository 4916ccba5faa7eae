"""Streaming jobs over the driver tables, checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from querybook import SQL, query
from querybook.derived import CUT, table, ts
from querybook.lifecycle import tasks
from shelfdelta.session import staging_path
from shelfdelta.sources.tables import Store
from shelfdelta.streaming import status as ST
from shelfdelta.streaming.retry import RetryTable
from shelfdelta.streaming.writer import TrackedStream


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _documents(items: DataFrame) -> DataFrame:
    """Line items as JSON product documents of one source."""
    key = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    later = (F.col("l_shipdate") >= ts(CUT)) & (F.col("l_partkey") % 3 == 0)
    price = F.col("l_partkey") + F.when(later, 1).otherwise(0)
    doc = F.struct(F.lit("LINES").alias("source"), key.alias("product_id"), price.alias("price"),
                   F.col("l_shipdate").cast("string").alias("scraped_at"))
    return items.select(F.to_json(doc).alias("doc"))


# Copies of an item within a run differ in the crawl stamp alone; every third part has another price in the second run.
@query(f"""WITH o AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),
n AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')
SELECT CASE WHEN o.l_partkey IS NULL THEN 'added' WHEN n.l_partkey IS NULL THEN 'deleted'
  WHEN n.l_partkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS change_type,
 count(*) AS n FROM o FULL OUTER JOIN n USING (l_partkey, l_linenumber) GROUP BY 1""")
def tracked_writer_stream(spark, sf) -> DataFrame:
    """Two streamed runs into a store; the second is compared with the first.

    The crawl stamp differs on every copy and must not count as a change.
    """
    store = Store(spark, staging_path(spark, "store"))
    runs = [("run-1", F.col("l_shipdate") < ts(CUT), "2024-01-01"), ("run-2", F.col("l_shipdate") >= ts(CUT), "2024-02-01")]
    for run_id, part, at in runs:
        writer = TrackedStream(store, "Lines", run_id, ts(at), "task-" + run_id)
        writer.drain(_documents(stream(spark, sf, "lineitem").filter(part)))
        found = writer.finalize()
    counted = spark.createDataFrame([(k, found["changes"][k]) for k in ("unchanged",)], "change_type string, n bigint")
    logged = store.read("changes").filter(F.col("task_id") == "task-run-2").groupBy("change_type").agg(
        F.count("*").alias("n"))
    return logged.unionByName(counted)


def _status_messages(spark, sf) -> DataFrame:
    """A stream of status messages as JSON, some broken."""
    rows = stream(spark, sf, "events")
    kind = F.col("event_type")
    status = (F.when(kind == "view", "queued").when(kind == "click", "started").when(kind == "purchase", "running")
              .when(kind == "signup", "retrying").when(F.col("value") > 40, "failed").otherwise("running"))
    body = F.to_json(F.struct(
        F.lit("task_status").alias("message_type"), F.col("user_id").cast("string").alias("task_id"), status.alias("status"),
        F.when(kind == "purchase", F.floor("value").cast("bigint")).alias("duration_ms"),
        F.when(kind == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))
    broken = F.struct(F.lit("not json").alias("body"))
    return rows.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.inline(F.when(
        kind == "view", F.array(F.struct(body.alias("body")), broken)).otherwise(F.array(F.struct(body.alias("body"))))))


def status_stream(spark, sf) -> DataFrame:
    """Status messages through the log into the task view."""
    sent = _status_messages(spark, sf)
    folder = staging_path(spark, "status")
    ST.start_log(sent, folder, "body").awaitTermination()
    log = ST.logged(spark, folder)
    # Every message was sent in event order, so the sequence number is the arrival.
    out = ST.task_view(tasks(spark, sf), log, [F.col("seq")])
    bad = ST.logged(spark, folder, "quarantined").agg(F.count("*"))
    return out.select("id", "status", "duration_ms", "error_message", bad.scalar().alias("quarantined"))


def status_folded_stream(spark, sf) -> DataFrame:
    """The same messages kept as folds by task, merged in levels."""
    folder = staging_path(spark, "status")
    ST.start_folds(_status_messages(spark, sf), folder, order=[F.col("seq")]).awaitTermination()
    out = ST.folded_view(tasks(spark, sf), folder)
    bad = spark.read.parquet(f"{folder}/quarantine").agg(F.count("*"))
    return out.select("id", "status", "duration_ms", "error_message", bad.scalar().alias("quarantined"))


for _stream in (status_stream, status_folded_stream):
    query(SQL["status_apply_guarded"].replace(
        "SELECT t.id,", "SELECT t.id, (SELECT count(*) FROM events WHERE event_type = 'view') AS quarantined,"))(_stream)


@query()
def lifecycle_stream(spark, sf) -> DataFrame:
    """The lifecycle per task from folds of micro-batches; equal to ``lifecycle_fold`` once drained."""
    rows = stream(spark, sf, "events")
    kind = F.col("event_type")
    status = (F.when(kind == "view", "queued").when(kind == "click", "started").when(kind == "purchase", "running")
              .when(kind == "signup", "retrying").when(F.col("value") > 40, "failed").otherwise("running"))
    sent = rows.select(F.col("user_id").cast("string").alias("task_id"), status.alias("status"), F.col("event_id").alias("seq"))
    folder = staging_path(spark, "lifecycle")
    ST.start_lifecycle(sent, folder).awaitTermination()
    return ST.lifecycle_view(spark, folder)


SQL["lifecycle_stream"] = SQL["lifecycle_fold"]


# Deliveries of every seventh event fail twice, those of every eleventh always.
@query("""SELECT CASE WHEN event_id % 11 = 0 THEN 'dead' ELSE 'delivered' END AS outcome,
 CASE WHEN event_id % 11 = 0 THEN 4 WHEN event_id % 7 = 0 THEN 3 ELSE 1 END AS attempts,
 CASE WHEN event_id % 11 = 0 THEN 'refused' WHEN event_id % 7 = 0 THEN 'busy' END AS last_error,
 count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL""")
def retry_stream(spark, sf) -> DataFrame:
    """Every event through a sink that fails for some: delivered or dead, after how many attempts."""
    sent = stream(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("task_id"))

    def sink(due: DataFrame) -> DataFrame:
        return due.withColumn("error", F.when(F.col("seq") % 11 == 0, "refused").when((F.col("seq") % 7 == 0) & (F.col("attempts") < 2), "busy"))

    table = RetryTable(spark, staging_path(spark, "retry"), "seq bigint, task_id string", sink, attempts=4, wait_seconds=0)
    table.start(sent).awaitTermination()
    while table.redeliver():
        pass
    ended = table.delivered().withColumn("outcome", F.lit("delivered")).unionByName(table.dead().withColumn("outcome", F.lit("dead")))
    return ended.groupBy("outcome", "attempts", "last_error").agg(F.count("*").alias("messages"), F.sum("seq").alias("ids"))
