import random

from pyspark.sql import functions as F

from shelfdelta.functions import fixed
from shelfdelta.operators import tasks as K

MESSAGE = ("seq long, task_id string, status string, celery_task_id string, queued_at timestamp_ntz, started_at timestamp_ntz, "
           "completed_at timestamp_ntz, duration_ms long, retries_attempted int, error string")


def skewed(n=6000, seed=3):
    """A third of all messages belongs to one task."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        task = "hot" if rng.random() < 1 / 3 else f"t{rng.randrange(200)}"
        status = rng.choice(["queued", "started", "running", "retrying"] * 30 + ["completed", "failed"])
        rows.append((seq, task, status, None, None, None, None, rng.choice([None, seq]), rng.choice([None, 1, 2]),
                     rng.choice([None, f"e{seq}"])))
    rng.shuffle(rows)
    return rows


def test_fold_under_skew_equals_a_plain_loop(spark):
    rows = skewed()
    state = {}
    for r in sorted(rows):
        s = state.setdefault(r[1], {"status": None, "duration_ms": None, "retries_attempted": None, "error": None, "n": 0})
        if s["status"] in fixed.TERMINAL_STATUSES:
            continue
        s["status"], s["n"] = r[2], s["n"] + 1
        for name, i in (("duration_ms", 7), ("retries_attempted", 8), ("error", 9)):
            s[name] = r[i] if r[i] is not None else s[name]
    out = K.folded_messages(spark.createDataFrame(rows, MESSAGE)).collect()
    assert {r.task_id: {"status": r.status, "duration_ms": r.duration_ms, "retries_attempted": r.retries_attempted,
                        "error": r.error, "n": r.applied} for r in out} == state


def test_strict_lifecycle_under_skew_equals_a_plain_loop(spark):
    rows = skewed(seed=5)
    state = {}
    for r in sorted(rows):
        now = state.get(r[1], "pending")
        state[r[1]] = r[2] if r[2] in fixed.TRANSITIONS[now] else now
    for width in (1, 50, 10**9):
        out = K.lifecycle_fold(spark.createDataFrame(rows, MESSAGE), run=width)
        assert {r.task_id: r.status for r in out.collect()} == state


def test_hot_tasks_are_salted_without_change(spark):
    rows = spark.createDataFrame(skewed(seed=6), MESSAGE)
    fold = lambda n: {r.task_id: r for r in K.folded_messages(rows, per_salt=n).collect()}
    assert fold(20) == fold(10**9)
    assert K.effective_messages(rows, per_salt=20).agg(F.max("_salt")).first()[0] > 0


def task_rows(spark):
    rows = [(f"{i:024x}", s) for i, s in enumerate(fixed.TASK_STATUSES)]
    at = "2024-01-01 10:00:00"
    return spark.createDataFrame([(i, s, None, at if s != "pending" else None, None, None, None, None, None) for i, s in rows],
                                 "id string, status string, q string, s string, c string, duration_ms long, retries_attempted int, "
                                 "celery_task_id string, error_message string").select(
        "id", "status", *[F.col(a).cast("timestamp_ntz").alias(b) for a, b in (("q", "queued_at"), ("s", "started_at"),
                                                                              ("c", "completed_at"))],
        "duration_ms", "retries_attempted", "celery_task_id", "error_message")


def test_every_transition(spark):
    tasks = task_rows(spark)
    at = F.lit("2024-01-01 10:00:01.500").cast("timestamp_ntz")
    for new in fixed.TASK_STATUSES:
        moves = tasks.select("id", F.lit(new).alias("new_status"))
        before = {r.id: r.status for r in tasks.collect()}
        for r in K.set_status(tasks, moves, at).collect():
            allowed = new in fixed.TRANSITIONS[before[r.id]]
            assert r.accepted == allowed and r.status == (new if allowed else before[r.id])
            if allowed and new in fixed.TERMINAL_STATUSES and r.started_at:
                assert r.duration_ms == 1500
            assert (r.queued_at is not None) == (allowed and new == "queued")


def test_message_outcomes(spark):
    ids = {s: f"{i:024x}" for i, s in enumerate(fixed.TASK_STATUSES)}
    sent = [(1, ids["running"], "failed"), (2, ids["running"], "running"), (3, ids["failed"], "running"), (4, "f" * 24, "running"),
            (5, "bad id", "running"), (6, ids["queued"], "started")]
    rows = spark.createDataFrame([(a, b, c, None, None, None, None, None, None, None) for a, b, c in sent], MESSAGE)
    out = {r.seq: r.outcome for r in K.dispositions(rows, task_rows(spark)).collect()}
    assert out == {1: "applied", 2: "skipped_terminal", 3: "skipped_terminal", 4: "unknown_task", 5: "invalid_id", 6: "applied"}
    after = {r.id: r.status for r in K.apply_messages(task_rows(spark), rows).collect()}
    assert (after[ids["running"]], after[ids["failed"]], after[ids["queued"]]) == ("failed", "failed", "started")
