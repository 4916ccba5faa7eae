"""Task admission, guarded status updates and lifecycle folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfdelta.functions import fixed, status as S
from shelfdelta.functions import predicates as W

# Task column ← message column.
_COPIED = {
    "queued_at": "queued_at", "started_at": "started_at", "completed_at": "completed_at",
    "celery_task_id": "celery_task_id", "duration_ms": "duration_ms",
    "retries_attempted": "retries_attempted", "error_message": "error",
}
ID_PATTERN = "^[0-9a-fA-F]{24}$"


def admit(requests: DataFrame, tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with a verdict: ``accepted`` or why not.

    A request is turned down when it is malformed, names an unknown site, or its
    user has an open task for the site. Open tasks shrink to one row per
    (site, user) before the join.
    """
    sites = registry.select(F.col("site_id").alias("site"), "base_url", F.lit(True).alias("_known"))
    busy = tasks.filter(W.open_status()).select("site", "user_id").distinct().withColumn("_busy", F.lit(True))
    problem = W.task_request_problem()
    joined = requests.join(sites, "site", "left").join(busy, ["site", "user_id"], "left")
    return joined.withColumn("verdict", F.when(problem.isNotNull(), F.concat(F.lit("invalid: "), problem))
                             .when(F.col("_known").isNull(), "scraper not found")
                             .when(F.col("_busy").isNotNull(), "site busy")
                             .otherwise("accepted")).drop("_known", "_busy")


def not_cancelled(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Queued runs whose task was not cancelled meanwhile."""
    cancelled = tasks.filter(F.col("status") == "cancelled").select(F.col("id").alias("task_id"))
    return runs.join(cancelled, "task_id", "left_anti")


def first_ends(messages: DataFrame, order: str = "seq") -> DataFrame:
    """Per task, where its first terminal message stands."""
    return messages.filter(W.terminal_status()).groupBy("task_id").agg(F.min(order).alias("_end"))


def effective_messages(messages: DataFrame, order: str = "seq", per_salt: int = 2_000_000) -> DataFrame:
    """Per task, the messages up to and including its first terminal one, with
    their ``_salt``.

    ``order`` is the arrival number. A task with more than ``per_salt`` messages is
    spread over as many sub-keys as it takes to hold each below that, and its
    cut-off is repeated for them; all other tasks have one sub-key. There are at most
    (messages / ``per_salt``) such tasks; the counts combine on the map side.
    """
    ends = messages.groupBy("task_id").agg(F.min(F.when(W.terminal_status(), F.col(order))).alias("_end"), F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / per_salt).cast("int").alias("_salts")
    hot = ends.filter(F.col("_n") > per_salt).select("task_id", salts)
    spread = messages.join(hot, "task_id", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(order), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    cuts = ends.filter(F.col("_end").isNotNull()).select("task_id", "_end", salts).select(
        "task_id", "_end", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return spread.join(cuts, ["task_id", "_salt"], "left").filter(
        F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def folded_messages(messages: DataFrame, order: str = "seq", per_salt: int = 2_000_000) -> DataFrame:
    """One row per task: its last effective status and the last value of every field.

    Folds per (task, salt) where the join left the rows, then per task.
    """
    live = effective_messages(messages, order, per_salt)
    fields = ["status", *_COPIED.values()]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(
        F.col(order).alias("at"), F.col(c).alias("value")))).alias(c)
    parts = live.groupBy("task_id", "_salt").agg(*[last(c) for c in fields], F.count("*").alias("applied"))
    return parts.groupBy("task_id").agg(
        *[F.max(c)["value"].alias(c) for c in fields], F.sum("applied").alias("applied"))


def apply_messages(tasks: DataFrame, messages: DataFrame, order: str = "seq") -> DataFrame:
    """Tasks after a set of status messages; ended tasks stay as they are."""
    return apply_fold(tasks, folded_messages(messages, order))


#: What ``message_folds`` gives: a batch's messages up to the first terminal one, by task.
FOLD = ("task_id string, ended boolean, applied bigint, status string, queued_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, "
        "duration_ms bigint, retries_attempted int, celery_task_id string, error string")


def message_folds(messages: DataFrame, order: str = "seq", per_salt: int = 2_000_000) -> DataFrame:
    """(task_id, ended, applied, last values): folds that ``chained_folds`` can go on with."""
    fold = folded_messages(messages, order, per_salt).withColumn("ended", F.coalesce(S.is_terminal(F.col("status")), F.lit(False)))
    fields = T.StructType.fromDDL(FOLD).fields
    return fold.select(*[(F.col(f.name) if f.name in fold.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def chained_folds(parts: DataFrame) -> DataFrame:
    """Folds in the order of ``_slot`` as one per task: what comes after an ended one has no effect.

    A task has one fold per block that is read, so a list is bounded by the number of blocks.
    """
    names = [f.name for f in T.StructType.fromDDL(FOLD).fields if f.name not in ("task_id", "ended", "applied")]
    lists = parts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("_slot", "ended", "applied", *names))).alias("_ps"))
    first_end = F.array_position(F.transform("_ps", lambda p: p["ended"]), True)
    live = lists.select("task_id", F.when(first_end > 0, F.slice("_ps", F.lit(1), first_end.cast("int"))).otherwise(F.col("_ps")).alias("_ps"))
    last = lambda n: F.try_element_at(F.filter(F.transform("_ps", lambda p: p[n]), lambda v: v.isNotNull()), F.lit(-1)).alias(n)
    return live.select("task_id", F.exists("_ps", lambda p: p["ended"]).alias("ended"),
                       F.aggregate("_ps", F.lit(0).cast("bigint"), lambda a, p: a + p["applied"]).alias("applied"), *[last(n) for n in names])


def apply_fold(tasks: DataFrame, fold: DataFrame) -> DataFrame:
    """Tasks after messages folded by task; ended tasks stay as they are."""
    news = fold.select(F.col("task_id").alias("_task"), F.col("status").alias("_status"),
                       *[F.col(m).alias(f"_{m}") for m in _COPIED.values()])
    joined = tasks.join(news, tasks["id"] == F.col("_task"), "left")
    guard = F.col("_task").isNotNull() & W.open_status()
    changed = {"status": F.when(guard, F.col("_status")).otherwise(F.col("status"))}
    for column, message in _COPIED.items():
        if column in tasks.columns:
            changed[column] = F.when(guard, F.coalesce(F.col(f"_{message}"), F.col(column))).otherwise(F.col(column))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in tasks.columns])


def dispositions(messages: DataFrame, tasks: DataFrame, order: str = "seq",
                 id_pattern: str | None = ID_PATTERN) -> DataFrame:
    """What became of every message: applied, skipped as late, unknown task, bad id."""
    ended = tasks.select(F.col("id").alias("task_id"), W.terminal_status().alias("_ended"))
    # One look-up of a row per task, so that the messages are joined once and AQE can
    # split a task that holds very many of them.
    known = ended.join(first_ends(messages, order), "task_id", "full_outer")
    joined = messages.join(known, "task_id", "left")
    late = F.col("_ended") | (F.col("_end").isNotNull() & (F.col(order) > F.col("_end")))
    bad = ~F.col("task_id").rlike(id_pattern) if id_pattern else F.lit(False)
    return joined.withColumn("outcome", F.when(bad, "invalid_id")
                             .when(F.col("_ended").isNull(), "unknown_task")
                             .when(late, "skipped_terminal")
                             .otherwise("applied")).drop("_ended", "_end")


def set_status(tasks: DataFrame, moves: DataFrame, at: Column, checked: bool = True) -> DataFrame:
    """Apply one requested status per task (``id, new_status``).

    ``checked`` enforces the transition table and stamps the whole lifecycle;
    otherwise it is the bulk mode, which checks nothing and stamps only the end.
    Adds ``accepted`` for the requested moves.
    """
    joined = tasks.join(moves.select("id", "new_status"), "id", "left")
    new = F.col("new_status")
    ok = new.isNotNull() & (S.transition_allowed(F.col("status"), new) if checked else F.lit(True))
    if checked:
        values = S.stamps(new, at, F.col("queued_at"), F.col("started_at"), F.col("completed_at"))
        values["duration_ms"] = F.coalesce(values["duration_ms"], F.col("duration_ms"))
    else:
        values = {"completed_at": F.when(S.is_terminal(new), at).otherwise(F.col("completed_at"))}
    values["status"] = new
    return joined.select(*[F.when(ok, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
                           for c in tasks.columns], F.when(new.isNotNull(), ok).alias("accepted"))


def in_runs(messages: DataFrame, order: str = "seq", run: int = 65_536) -> DataFrame:
    """``messages`` with ``_slot``: numbers of runs of at most ``run`` messages that are
    consecutive in (task, ``order``). Range partitions split a hot task, so no task of
    the cluster holds one whole."""
    placed = messages.repartitionByRange("task_id", order).sortWithinPartitions("task_id", order)
    return placed.withColumn("_slot", F.floor(F.monotonically_increasing_id() / run))


def chained(parts: DataFrame, *by: str) -> DataFrame:
    """Folds ``_f`` of consecutive ``_slot`` chained into one per ``by``."""
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_slot", "_f", "_n"))).alias("_ps"))
    return lists.select(*by, F.aggregate("_ps", S.start_states(), lambda acc, p: S.chain(acc, p["_f"])).alias("_f"),
                        F.aggregate("_ps", F.lit(0).cast("bigint"), lambda a, p: a + p["_n"]).alias("_n"))


def lifecycle_parts(messages: DataFrame, order: str = "seq", run: int = 65_536) -> DataFrame:
    """(task_id, _f, _n): per task, the status each possible status ends in after its
    messages, and their number.

    Whether a message counts depends on all before it, so this is a sequential fold.
    It still splits: a run of messages is a function from each possible status to a
    status, and such functions compose. Runs fold first, then 4,096 runs at a time, then
    the few functions left of a task: no list outgrows its bound with the data.
    """
    rows = in_runs(messages, order, run).select("task_id", "_slot", F.struct(order, "status").alias("_m"))
    lists = rows.groupBy("task_id", "_slot").agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
    local = F.aggregate("_ms", S.start_states(), lambda acc, m: S.step(acc, m["status"]))
    folds = lists.select("task_id", "_slot", local.alias("_f"), F.size("_ms").cast("bigint").alias("_n"))
    blocks = chained(folds.withColumn("_block", F.floor(F.col("_slot") / 4096)), "task_id", "_block")
    return chained(blocks.withColumnRenamed("_block", "_slot"), "task_id")


def ended(parts: DataFrame, start: str = "pending") -> DataFrame:
    """(task_id, status, messages) of folds that begin with ``start``."""
    return parts.select("task_id", F.get("_f", F.lit(fixed.TASK_STATUSES.index(start))).alias("status"), F.col("_n").alias("messages"))


def lifecycle_fold(messages: DataFrame, order: str = "seq", run: int = 65_536, start: str = "pending") -> DataFrame:
    """Final status per task when every message must pass the transition table."""
    return ended(lifecycle_parts(messages, order, run), start)


def consecutive_statuses(messages: DataFrame, order: str = "seq", run: int = 65_536, start: str = "pending") -> DataFrame:
    """(from_status, to_status, n) over consecutive messages of every task.

    Pairs inside a run of messages are counted in it; between runs only each run's
    first and last status travel.
    """
    lists = in_runs(messages, order, run).groupBy("task_id", "_slot").agg(
        F.array_sort(F.collect_list(F.struct(order, "status"))).alias("_ms"))
    pair = lambda a, b: F.struct(a.alias("from_status"), b.alias("to_status"))
    inside = lists.select(F.inline(F.transform(F.slice("_ms", F.lit(2), F.size("_ms")), lambda m, i: pair(
        F.get("_ms", i)["status"], m["status"]))))
    edges = lists.select("task_id", "_slot", F.get("_ms", F.lit(0))["status"].alias("to_status"), F.element_at("_ms", -1)["status"].alias("_last"))
    before = F.lag("_last", 1, start).over(Window.partitionBy("task_id").orderBy("_slot"))
    between = edges.select(before.alias("from_status"), "to_status")
    return inside.unionByName(between).groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


def run_outcomes(attempts: DataFrame) -> DataFrame:
    """Per task: outcome of its last attempt, attempts made, whether it was retried."""
    return attempts.groupBy("task_id").agg(
        F.max_by("status", "retry").alias("status"),
        F.max("retry").cast("bigint").alias("retries_attempted"),
        F.count("*").alias("attempts"))


def dispatch_order(tasks: DataFrame, limit: int) -> DataFrame:
    """The pending tasks to send next: highest priority, then oldest."""
    return tasks.filter(F.col("status") == "pending").orderBy(
        F.col("priority").desc(), F.col("created_at").asc(), F.col("id").asc()).limit(limit)
