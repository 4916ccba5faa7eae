"""Levelled folds: few files for many batches, equal to the fold of all, swept with a grace."""

import pytest
from pyspark.sql import functions as F

from shelfdelta.operators import tasks as K
from shelfdelta.streaming import status as ST
from shelfdelta.streaming.levels import Levels, blocks


def test_blocks_hold_every_batch_once():
    for base in (2, 3, 8):
        for n in (0, 1, 7, 8, 64, 333, 1000):
            covered = [x for level, b in blocks(n, base) for x in range(b * base**level, (b + 1) * base**level)]
            assert covered == list(range(n))
    assert len(blocks(1000, 8)) == 13 and len(blocks(1_000_000, 8)) < 50


def rows_of(n):
    """Batch n: some tasks move, every seventh batch ends one that later batches would move again."""
    return [(f"t{(n * 5 + i) % 11}", "completed" if n % 7 == 3 and i == 0 else ("queued", "running", "retrying")[(n + i) % 3], n * 10 + i, n if i % 2 else None)
            for i in range(4)]


@pytest.fixture(scope="module")
def folded(spark, tmp_path_factory):
    """Twenty-two batches of folds in levels of three."""
    levels = Levels(spark, str(tmp_path_factory.mktemp("levels")), K.FOLD, K.chained_folds, base=3)
    sent = []
    for n in range(22):
        sent += rows_of(n)
        batch = spark.createDataFrame(rows_of(n), "task_id string, status string, seq long, duration_ms long").withColumns(
            {c: F.lit(None).cast(t) for c, t in (("queued_at", "timestamp_ntz"), ("started_at", "timestamp_ntz"), ("completed_at", "timestamp_ntz"),
                                                 ("celery_task_id", "string"), ("retries_attempted", "int"), ("error", "string"))})
        levels.add(K.message_folds(batch), n)
        if n == 21:
            levels.add(K.message_folds(batch), n)  # a repeated batch replaces itself
    return levels, sent


def plain(sent):
    out = {}
    for task, status, _, duration in sent:
        have = out.setdefault(task, [None, None, 0])
        if have[0] != "completed":
            have[:] = [status, duration if duration is not None else have[1], have[2] + 1]
    return {t: tuple(v) for t, v in out.items()}


def test_view_equals_the_fold_of_all(folded):
    levels, sent = folded
    assert levels.batches() == 22 and len(levels.current()) == len(blocks(22, 3)) == 4
    assert {r.task_id: (r.status, r.duration_ms, r.applied) for r in levels.read().collect()} == plain(sent)
    assert {r.task_id for r in levels.read().filter("ended").collect()} == {t for t, v in plain(sent).items() if v[0] == "completed"}


def test_sweep_leaves_readers_within_the_grace(folded):
    levels, sent = folded
    old = levels._read(blocks(20, 3))  # a reader that began two batches ago
    assert levels.sweep(grace=2) > 0 and levels.sweep(grace=2) == 0
    assert {r.task_id: (r.status, r.duration_ms, r.applied) for r in levels.merge(old).collect()} == plain(rows for n in range(20) for rows in rows_of(n))
    assert {r.task_id: (r.status, r.duration_ms, r.applied) for r in levels.read().collect()} == plain(sent)


def test_a_batch_that_died_is_not_seen(spark, tmp_path):
    levels = Levels(spark, str(tmp_path), "task_id string, n bigint", lambda df: df.groupBy("task_id").agg(F.sum("n").alias("n")), base=2)
    one = spark.createDataFrame([("a", 1)], "task_id string, n bigint")
    assert levels.read().count() == 0
    levels.add(one, 0)
    one.write.parquet(levels._path(0, 1))  # written, but neither merged nor marked
    assert levels.read().first().n == 1
    levels.add(one, 1)
    assert levels.read().first().n == 2 and levels.current() == [(1, 0)]


def test_stream_of_folds_over_several_batches(spark, tmp_path):
    import json
    inbox = tmp_path / "in"
    inbox.mkdir()
    sent = [[("a", "running"), ("b", "queued")], [("a", "completed"), ("x", None)], [("a", "failed"), ("b", "running")]]
    for i, batch in enumerate(sent):
        (inbox / f"{i}.txt").write_text("\n".join(json.dumps({"message_type": "task_status", "task_id": t, "status": s}) if s else "{broken" for t, s in batch))
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(inbox)).withColumnRenamed("value", "body")
    ST.start_folds(raw, str(tmp_path / "out")).awaitTermination()
    tasks = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "completed")], "id string, status string")
    got = {r.id: r.status for r in ST.folded_view(tasks, str(tmp_path / "out")).collect()}
    assert got["c"] == "completed" and got["a"] in ("completed", "failed") and got["b"] in ("running", "queued")
    assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1
