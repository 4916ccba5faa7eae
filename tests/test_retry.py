import json

import pytest
from pyspark.sql import functions as F

from shelfdelta.streaming.retry import RetryTable, known_tasks

SCHEMA = "id long, task_id string"


def failing(times, forever=()):
    """A sink that fails ``times`` deliveries of odd ids, and always those of ``forever``."""
    def sink(due):
        bad = ((F.col("id") % 2 == 1) & (F.col("attempts") < times)) | F.col("id").isin(*forever)
        return due.withColumn("error", F.when(bad, F.concat(F.lit("try "), F.col("attempts"))))
    return sink


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def told(df):
    return sorted((r.id, r.attempts, r.last_error) for r in df.collect())


def test_a_sink_that_fails_twice_delivers_each_message_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, ids in (("1", (1, 2, 3)), ("2", (4, 5))):
        (inbox / f"{name}.json").write_text("".join(json.dumps({"id": i, "task_id": f"t{i}"}) + "\n" for i in ids))
    table = RetryTable(spark, str(tmp_path / "job"), SCHEMA, failing(2, forever=[5]), attempts=4, wait_seconds=0)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
    table.start(stream).awaitTermination()
    while table.redeliver():
        pass
    assert told(table.delivered()) == [(1, 3, "try 1"), (2, 1, None), (3, 3, "try 1"), (4, 1, None)]
    assert told(table.dead()) == [(5, 4, "try 3")]
    assert table.pending().isEmpty()


def test_repeated_and_broken_rounds(spark, tmp_path):
    folder, broken = str(tmp_path / "job"), {"on": False}

    def sink(due):
        out = failing(1)(due)
        if broken["on"]:
            return out.withColumn("error", F.raise_error(F.lit("sink is down")).cast("string"))
        return out

    table = RetryTable(spark, folder, SCHEMA, sink, wait_seconds=0)
    table.add(rows(spark, 1, 2), 0)
    table.add(rows(spark, 1, 2), 0)  # the stream plays the batch again
    assert told(table.delivered()) == [(2, 1, None)] and told(table.pending()) == [(1, 1, "try 0")]
    broken["on"] = True
    with pytest.raises(Exception, match="sink is down"):
        table.add(rows(spark, 4), 1)
    assert told(table.delivered()) == [(2, 1, None)] and told(table.pending()) == [(1, 1, "try 0")]
    broken["on"] = False
    table.add(rows(spark, 4), 1)
    assert told(table.delivered()) == [(1, 2, "try 0"), (2, 1, None), (4, 1, None)]
    assert table.pending().isEmpty() and table.sweep(1) == 1 and table.delivered().count() == 3


def test_waits_double(spark, tmp_path):
    clock = {"at": "2024-01-01 00:00:00"}
    table = RetryTable(spark, str(tmp_path / "job"), SCHEMA, failing(9), attempts=9, wait_seconds=10,
                       now=lambda: F.lit(clock["at"]).cast("timestamp"))
    tried = []
    table.add(rows(spark, 1), 0)
    for second in range(1, 36):
        if second in (9, 10, 29, 30):
            clock["at"] = f"2024-01-01 00:00:{second:02d}"
            table.redeliver()
            tried.append((second, table.pending().first().attempts))
    assert tried == [(9, 1), (10, 2), (29, 2), (30, 3)]


def test_unknown_tasks_come_back_and_null_ids_do_not(spark, tmp_path):
    known = {"ids": ["a", "a"]}
    tasks = lambda: spark.createDataFrame([(i,) for i in known["ids"]], "id string")
    table = RetryTable(spark, str(tmp_path / "job"), SCHEMA, known_tasks(tasks), wait_seconds=0)
    assert not table.redeliver() and table.pending().isEmpty() and table.delivered().isEmpty()
    table.add(spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, None)], SCHEMA), 0)
    assert told(table.delivered()) == [(1, 1, None)] and told(table.dead()) == [(3, 1, "no task id")] * 2
    known["ids"] = ["a", "b"]
    table.add(spark.createDataFrame([], SCHEMA), 1)  # an empty batch redelivers
    assert told(table.delivered()) == [(1, 1, None), (2, 2, "unknown task")]


def test_what_a_broken_round_left_is_not_seen_later(spark, tmp_path):
    folder = str(tmp_path / "job")
    table = RetryTable(spark, folder, SCHEMA, failing(1), wait_seconds=0)
    table.add(rows(spark, 1), 0)
    # A redelivery that wrote its rows and died before it was marked as done.
    left = spark.createDataFrame([(1, "t1", 2, None, "try 0")], SCHEMA + ", attempts int, next_at timestamp, last_error string")
    left.write.parquet(f"{folder}/rounds/round=r{0:012d}_{1:06d}/kind=delivered")
    assert table.delivered().isEmpty()
    table.add(rows(spark, 2), 1)
    assert told(table.delivered()) == [(1, 2, "try 0"), (2, 1, None)]
