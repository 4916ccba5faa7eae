import json

import pytest
from pyspark.sql import functions as F

from shelfdelta.operators import paging
from shelfdelta.sources import messages as MS
from shelfdelta.sources.tables import Store
from shelfdelta.streaming import status as ST
from shelfdelta.streaming.writer import TrackedStream

def now():
    return F.lit("2024-01-01").cast("timestamp_ntz")


def write_text(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def text_stream(spark, folder):
    return spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select(F.col("value").alias("doc"))


def item(pid, price):
    return json.dumps({"product_id": pid, "price_cents": price})


def test_micro_batches_then_one_sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write_text(tmp_path / "r1", "a.txt", [item(f"v{i}", 1000) for i in range(3)])
    write_text(tmp_path / "r1", "b.txt", [item("v3", 1000), item("v4", 1000), item("v4", 1000)])
    first = TrackedStream(store, "Printify", "r1", now())
    first.drain(text_stream(spark, tmp_path / "r1"))
    assert first.finalize()["changes"] == {"added": 5, "updated": 0, "deleted": 0, "unchanged": 0, "soft_deleted": 0}
    with pytest.raises(RuntimeError):
        first.finalize()

    second = TrackedStream(store, "printify", "r2", now())
    batch = lambda *rows: spark.createDataFrame([(r,) for r in rows], "doc string")
    second.process_batch(batch(item("v0", 1000), item("v1", 1500)), 0)
    second.process_batch(batch(item("v2", 1000), item("v3", 1000), item("v9", 1)), 1)
    # A retried batch replaces itself.
    second.process_batch(batch(item("v2", 1000), item("v3", 1000), item("v9", 1)), 1)
    assert second.finalize()["changes"] == {"added": 1, "updated": 1, "deleted": 1, "unchanged": 3, "soft_deleted": 1}

    third = TrackedStream(store, "printify", "r3", now(), partial=True)
    third.process_batch(batch(item("v4", 1000)), 0)
    result = third.finalize()
    assert result["changes"]["deleted"] == 0 and result["revived"] == 1
    assert store.catalog("printify").filter("deleted_at is null").count() == 6


def message(task, status, **more):
    return json.dumps({"message_type": "task_status", "task_id": task, "status": status, **more})


def test_poison_late_and_redelivered_messages(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "job")
    write_text(inbox, "1.txt", [message("a", "running"), "{broken", message("b", "no-such-status"), message(None, "running")])
    write_text(inbox, "2.txt", [message("a", "completed", duration_ms=7), message("a", "running", error="late")])
    raw = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(inbox)).select(F.col("value").alias("body"))
    ST.start_log(raw(), folder).awaitTermination()
    write_text(inbox, "3.txt", [message("a", "failed"), message("c", "queued")])
    ST.start_log(raw(), folder).awaitTermination()

    tasks = spark.createDataFrame([("a", "started", None, None), ("c", "pending", None, None), ("d", "pending", None, None)],
                                  "id string, status string, duration_ms long, error_message string")
    out = {r.id: (r.status, r.duration_ms, r.error_message) for r in ST.task_view(tasks, ST.logged(spark, folder)).collect()}
    assert out == {"a": ("completed", 7, None), "c": ("queued", None, None), "d": ("pending", None, None)}
    assert sorted(r.problem for r in ST.logged(spark, folder, "quarantined").collect()) == ["invalid", "invalid", "unreadable"]


def test_batch_parsing(spark):
    df = spark.createDataFrame([(message("a", "queued", data={"x": [1]}),), ("",)], "body string")
    good = MS.good(MS.parsed(df)).collect()
    assert len(good) == 1 and json.loads(good[0].data) == {"x": [1]}
    assert MS.quarantined(MS.parsed(df)).count() == 1


def test_progress_tail_of_a_task_with_most_lines(spark):
    lines = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 30))
                                     .alias("task_id"), F.col("id").alias("ts"), F.col("id").alias("seq"))
    kept = ST.progress_tail(lines).groupBy("task_id").agg(F.count("*").alias("n"), F.min("seq").alias("low")).collect()
    assert all(r.n == 100 for r in kept)
    plan = paging.last_rows(lines, "task_id", [F.col("ts").desc()], 100)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_redelivered_messages_are_dropped_within_the_delay(spark, tmp_path):
    inbox = tmp_path / "in"
    lines = [json.dumps({"id": i, "at": "2024-01-01T00:00:00Z", "body": message("a", "running")}) for i in (1, 2, 1)]
    write_text(inbox, "1.json", lines)
    write_text(inbox, "2.json", lines)
    raw = spark.readStream.schema("id long, at timestamp, body string").option("maxFilesPerTrigger", 1).json(str(inbox))
    ST.start_log(raw, str(tmp_path / "job"), message_id="id", at="at").awaitTermination()
    assert ST.logged(spark, str(tmp_path / "job")).count() == 2


def test_lifecycle_over_two_batches(spark, tmp_path):
    inbox, job = tmp_path / "in", str(tmp_path / "job")
    sent = lambda rows: [json.dumps({"task_id": t, "status": s, "seq": n}) for t, s, n in rows]
    write_text(inbox, "1.json", sent([("a", "started", 2), ("a", "queued", 1), ("b", "running", 1)]))
    rows = spark.readStream.schema("task_id string, status string, seq long").option("maxFilesPerTrigger", 1).json(str(inbox))
    ST.start_lifecycle(rows, job).awaitTermination()
    assert sorted(map(tuple, ST.lifecycle_view(spark, job).collect())) == [("a", "started", 2), ("b", "pending", 1)]
    write_text(inbox, "2.json", sent([("a", "running", 3), ("a", "completed", 4), ("a", "running", 5)]))
    ST.start_lifecycle(rows, job).awaitTermination()
    assert sorted(map(tuple, ST.lifecycle_view(spark, job).collect())) == [("a", "completed", 5), ("b", "pending", 1)]
