"""Task, message and activity queries.

Orders stand for tasks (site = priority class, user = customer), events for status
messages and for activity rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from querybook.derived import table, ts
from shelfdelta.functions import fixed, predicates as W, status as S
from shelfdelta.functions.text import clamp, iso_text
from shelfdelta.operators import paging, quality, stats, tasks as K
from shelfdelta.operators.diff import latest_per_key

_STATUSES = fixed.TASK_STATUSES
# The status of an order's task follows from its own status and priority; all eight occur.
_BY_ORDER = {
    "F": ["pending", "queued", "started", "running", "completed"],
    "O": ["failed", "retrying", "cancelled", "pending", "completed"],
    "P": ["queued", "running", "failed", "cancelled", "started"],
}
_STATUS_SQL = "CASE " + " ".join(
    f"WHEN o_orderstatus = '{o}' AND left(o_orderpriority, 1) = '{i}' THEN '{s}'"
    for o, names in _BY_ORDER.items() for i, s in enumerate(names, 1)) + " END"
_TASKS = f"""tasks AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, lower(o_orderpriority) AS site,
  'u' || o_custkey AS user_id, {_STATUS_SQL} AS status, o_orderdate AS created_at,
  o_orderdate + INTERVAL 5 MINUTES AS started_at,
  o_orderdate + INTERVAL 5 MINUTES + to_milliseconds(CAST(floor(o_totalprice) AS BIGINT)) AS completed_at,
  CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, CAST(left(o_orderpriority, 1) AS INT) AS priority FROM orders)"""


def tasks(spark, sf) -> DataFrame:
    """Every order as a task."""
    names = F.create_map(*[F.lit(x) for o, l in _BY_ORDER.items() for i, s in enumerate(l, 1) for x in (f"{o}{i}", s)])
    status = F.element_at(names, F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))))
    began = F.col("o_orderdate") + F.expr("INTERVAL 5 MINUTES")
    ms = F.floor("o_totalprice").cast("bigint")
    ended = began + F.make_dt_interval(secs=ms / F.lit(1000).cast("decimal(10,0)"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lower("o_orderpriority").alias("site"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("queued_at"),
        began.alias("started_at"), ended.alias("completed_at"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"),
        F.lit(None).cast("int").alias("retries_attempted"), F.lit(None).cast("string").alias("celery_task_id"),
        F.lit(None).cast("string").alias("error_message"))
    return rows.withColumn("duration_ms", S.duration_ms(F.col("started_at"), F.col("completed_at")))


@query(f"""WITH {_TASKS} SELECT count(*) AS total,
 {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUSES)},
 round(avg(duration_ms) FILTER (status = 'completed'), 3) AS avg_duration_ms,
 round(100.0 * count(*) FILTER (status = 'completed')
  / count(*) FILTER (status IN ('completed', 'failed', 'cancelled')), 6) AS success_rate FROM tasks""")
def task_summary(spark, sf) -> DataFrame:
    found = stats.task_summary(tasks(spark, sf))
    return found.withColumn("avg_duration_ms", F.round("avg_duration_ms", 3)).withColumn(
        "success_rate", F.round("success_rate", 6))


@query(f"""WITH {_TASKS}, mine AS (SELECT * FROM tasks WHERE user_id = 'u7' AND status <> 'failed')
SELECT id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, (SELECT count(*) FROM mine) AS total,
 CAST(1 AS BIGINT) AS page, CAST(5 AS BIGINT) AS page_size,
 CAST(ceil((SELECT count(*) FROM mine) / 5.0) AS BIGINT) AS total_pages, (SELECT count(*) FROM mine) > 5 AS has_next
 FROM mine ORDER BY tasks.created_at DESC, id LIMIT 5""".replace("tasks.created_at", "mine.created_at"))
def task_page(spark, sf) -> DataFrame:
    mine = tasks(spark, sf).filter(W.every(W.matching(user_id="u7"), F.col("status") != "failed")).select(
        "id", "status", "created_at")
    out = paging.paged(mine, [F.col("created_at").desc(), F.col("id")], 1, 5)
    return out.withColumn("created_at", iso_text(F.col("created_at")))


@query(f"""WITH {_TASKS} SELECT id, site, status FROM tasks WHERE id = '42' AND user_id = (
 SELECT 'u' || o_custkey FROM orders WHERE o_orderkey = 42)
 UNION ALL SELECT id, site, status FROM tasks WHERE id = '43' AND user_id = 'nobody'""")
def task_lookup(spark, sf) -> DataFrame:
    """A point lookup with its ownership check, and one that fails the check."""
    rows = tasks(spark, sf)
    owner = table(spark, sf, "orders").filter("o_orderkey = 42").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"))
    own = paging.lookup(rows, id="42").join(owner, "user_id", "left_semi")
    return own.unionByName(paging.lookup(rows, "nobody", id="43")).select("id", "site", "status")


@query(f"""WITH {_TASKS} SELECT id, site, priority FROM tasks WHERE status = 'pending'
 ORDER BY priority DESC, created_at, id LIMIT 100""")
def dispatch_topk(spark, sf) -> DataFrame:
    return K.dispatch_order(tasks(spark, sf), 100).select("id", "site", "priority")


@query(f"""WITH {_TASKS} SELECT DISTINCT site FROM tasks WHERE status NOT IN ('completed', 'failed', 'cancelled')""")
def active_sites(spark, sf) -> DataFrame:
    return stats.active_sites(tasks(spark, sf))


# Every customer asks for one site; some requests are malformed, some name no site.
_REQUESTS = """requests AS (SELECT c_custkey AS request_id, 'u' || c_custkey AS user_id,
  CASE WHEN c_acctbal < -500 THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'nowhere' ELSE '1-urgent' END AS site,
  CASE WHEN c_acctbal > 9000 THEN 11 ELSE 3 END AS max_retries FROM customer)"""


@query(f"""WITH {_TASKS}, {_REQUESTS},
busy AS (SELECT DISTINCT site, user_id FROM tasks WHERE status NOT IN ('completed', 'failed', 'cancelled'))
SELECT request_id, CASE WHEN r.site = '' THEN 'invalid: site is required'
 WHEN max_retries > 10 THEN 'invalid: max_retries outside 0-10' WHEN r.site = 'nowhere' THEN 'scraper not found'
 WHEN b.site IS NOT NULL THEN 'site busy' ELSE 'accepted' END AS verdict
 FROM requests r LEFT JOIN busy b ON r.site = b.site AND r.user_id = b.user_id""")
def admission_guard(spark, sf) -> DataFrame:
    wanted = (F.when(F.col("c_acctbal") < -500, "").when(F.col("c_mktsegment") == "MACHINERY", "nowhere")
              .otherwise("1-urgent"))
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        wanted.alias("site"), F.when(F.col("c_acctbal") > 9000, 11).otherwise(3).alias("max_retries"))
    registry = tasks(spark, sf).select(F.col("site").alias("site_id")).distinct().withColumn("base_url", F.lit(""))
    return K.admit(requests, tasks(spark, sf), registry).select("request_id", "verdict")


@query(f"""WITH {_TASKS} SELECT l_orderkey AS run_order, count(*) AS runs FROM lineitem
 WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT id FROM tasks WHERE status = 'cancelled') GROUP BY 1""")
def runs_not_cancelled(spark, sf) -> DataFrame:
    runs = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("task_id"))
    kept = K.not_cancelled(runs, tasks(spark, sf))
    return kept.groupBy(F.col("l_orderkey").alias("run_order")).agg(F.count("*").alias("runs"))


# Events are messages: the task is the user, the event type names the new status.
_MESSAGES = """msgs AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS task_id,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'running'
   WHEN 'signup' THEN 'retrying' ELSE CASE WHEN value > 40 THEN 'failed' ELSE 'running' END END AS status,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, ts FROM events)"""


def messages(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = (F.when(kind == "view", "queued").when(kind == "click", "started").when(kind == "purchase", "running")
              .when(kind == "signup", "retrying").when(F.col("value") > 40, "failed").otherwise("running"))
    none = F.lit(None)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("task_id"), status.alias("status"),
        none.cast("string").alias("celery_task_id"), none.cast("timestamp_ntz").alias("queued_at"),
        F.when(kind == "click", F.col("ts")).alias("started_at"), none.cast("timestamp_ntz").alias("completed_at"),
        F.when(kind == "purchase", F.floor("value").cast("bigint")).alias("duration_ms"),
        none.cast("int").alias("retries_attempted"),
        F.when(kind == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), "ts")


_FOLD = """cut AS (SELECT task_id, min(seq) AS last FROM msgs WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY 1),
live AS (SELECT m.* FROM msgs m LEFT JOIN cut c USING (task_id) WHERE c.last IS NULL OR m.seq <= c.last),
fold AS (SELECT task_id, arg_max(status, seq) AS status, arg_max(duration_ms, seq) FILTER (duration_ms IS NOT NULL) AS duration_ms,
  arg_max(error, seq) FILTER (error IS NOT NULL) AS error, count(*) AS applied FROM live GROUP BY 1)"""


@query(f"""WITH {_TASKS}, {_MESSAGES}, {_FOLD}
SELECT t.id, CASE WHEN g THEN f.status ELSE t.status END AS status,
 CASE WHEN g THEN coalesce(f.duration_ms, t.duration_ms) ELSE t.duration_ms END AS duration_ms,
 CASE WHEN g THEN f.error END AS error_message
FROM (SELECT *, status NOT IN ('completed', 'failed', 'cancelled') AS open FROM tasks) t
LEFT JOIN fold f ON t.id = f.task_id, LATERAL (SELECT t.open AND f.task_id IS NOT NULL AS g)""")
def status_apply_guarded(spark, sf) -> DataFrame:
    out = K.apply_messages(tasks(spark, sf), messages(spark, sf))
    return out.select("id", "status", "duration_ms", "error_message")


@query(f"""WITH {_TASKS}, {_MESSAGES}, {_FOLD}
SELECT m.seq, CASE WHEN m.task_id LIKE '%7' THEN 'invalid_id' WHEN t.id IS NULL THEN 'unknown_task'
 WHEN t.status IN ('completed', 'failed', 'cancelled') OR m.seq > c.last THEN 'skipped_terminal'
 ELSE 'applied' END AS outcome
FROM msgs m LEFT JOIN (SELECT * FROM tasks WHERE priority <> 5) t ON m.task_id = t.id LEFT JOIN cut c ON m.task_id = c.task_id""")
def message_dispositions(spark, sf) -> DataFrame:
    known = tasks(spark, sf).filter("priority <> 5")
    return K.dispositions(messages(spark, sf), known, id_pattern="[^7]$").select("seq", "outcome")


_ALLOWED = " OR ".join(f"(a = '{a}' AND b IN ({', '.join(repr(x) for x in n)}))" for a, n in fixed.TRANSITIONS.items() if n)


@query(f"""WITH {_MESSAGES}, pairs AS (SELECT task_id, lag(status, 1, 'pending') OVER (PARTITION BY task_id ORDER BY seq) AS a,
 status AS b FROM msgs)
SELECT a AS from_status, b AS to_status, count(*) AS n, ({_ALLOWED}) AS allowed FROM pairs GROUP BY a, b""")
def transition_audit(spark, sf) -> DataFrame:
    """Consecutive statuses per task against the transition table."""
    return K.consecutive_statuses(messages(spark, sf)).withColumn(
        "allowed", S.transition_allowed(F.col("from_status"), F.col("to_status")))


@query(f"""WITH {_MESSAGES}, lists AS (SELECT task_id, list(status ORDER BY seq) AS l, count(*) AS messages FROM msgs GROUP BY 1)
SELECT task_id, messages, list_reduce(l, lambda a, b: CASE WHEN {_ALLOWED} THEN b ELSE a END, 'pending') AS status FROM lists""")
def lifecycle_fold(spark, sf) -> DataFrame:
    """The strict lifecycle: refused moves leave the status as it is."""
    return K.lifecycle_fold(messages(spark, sf))


@query("""SELECT l_orderkey AS task_id, CASE WHEN count(*) > 4 THEN 'failed' ELSE 'completed' END AS status,
 count(*) - 1 AS retries_attempted, count(*) AS attempts FROM lineitem GROUP BY 1""")
def run_outcomes(spark, sf) -> DataFrame:
    """Every line item is one attempt; the attempt number is counted per task by
    a position inside the order, and the fifth attempt fails for good."""
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    attempts = sizes.select(F.col("l_orderkey").alias("task_id"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("n") - 1)).alias("retry")).withColumn(
        "status", F.when(F.col("retry") >= 4, "failed").otherwise("completed"))
    return K.run_outcomes(attempts)


@query(f"""WITH {_TASKS}, moves AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, max(CASE l_returnflag WHEN 'A' THEN 'cancelled'
  WHEN 'N' THEN 'queued' ELSE 'running' END) AS b FROM lineitem GROUP BY 1),
j AS (SELECT t.*, t.status AS a, b FROM tasks t LEFT JOIN moves m ON t.id = m.id)
SELECT id, CASE WHEN {_ALLOWED} THEN b ELSE a END AS status, ({_ALLOWED}) AS accepted,
 CASE WHEN ({_ALLOWED}) AND b = 'queued' THEN '2024-06-01' END AS queued,
 strftime(CASE WHEN ({_ALLOWED}) AND b = 'cancelled' THEN TIMESTAMP '2024-06-01' ELSE completed_at END, '%Y-%m-%d') AS completed
FROM j""".replace(f"({_ALLOWED}) AS accepted", f"CASE WHEN b IS NOT NULL THEN ({_ALLOWED}) END AS accepted"))
def checked_status_update(spark, sf) -> DataFrame:
    """Requested moves under the transition table, with lifecycle stamps."""
    wish = F.when(F.col("l_returnflag") == "A", "cancelled").when(F.col("l_returnflag") == "N", "queued").otherwise("running")
    moves = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.max(wish).alias("new_status"))
    out = K.set_status(tasks(spark, sf), moves, ts("2024-06-01"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("id", "status", "accepted", day("queued_at").alias("queued"), day("completed_at").alias("completed"))


@query(f"""WITH {_TASKS} SELECT id, CASE WHEN id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_discount = 0.1)
 THEN 'failed' ELSE status END AS status FROM tasks""")
def bulk_status_update(spark, sf) -> DataFrame:
    """The bulk mode: a key list moves to one status, unchecked."""
    moves = table(spark, sf, "lineitem").filter(F.col("l_discount") == 0.1).select(
        F.col("l_orderkey").cast("string").alias("id")).distinct().withColumn("new_status", F.lit("failed"))
    return K.set_status(tasks(spark, sf), moves, ts("2024-06-01"), checked=False).select("id", "status")


_ACTIVITY = """activity AS (SELECT event_id, 'U' || user_id || '@Mail.example' AS user_email, ts AS created_at,
  CASE event_type WHEN 'error' THEN 'LOGOUT' WHEN 'signup' THEN 'SIGNUP' ELSE 'LOGIN' END AS activity_type,
  event_type <> 'click' AS success FROM events)"""


def activity(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@Mail.example")).alias("user_email"),
        F.when(kind == "error", "LOGOUT").when(kind == "signup", "SIGNUP").otherwise("LOGIN").alias("activity_type"),
        (kind != "click").alias("success"), F.col("ts").alias("created_at"))


@query(f"""WITH {_ACTIVITY} SELECT
 count(*) FILTER (success AND created_at >= TIMESTAMP '2024-01-29') AS today_logins,
 count(*) FILTER (NOT success AND created_at >= TIMESTAMP '2024-01-29') AS today_failed_logins,
 count(*) FILTER (success) AS week_logins,
 count(DISTINCT user_email) FILTER (success AND created_at >= TIMESTAMP '2024-01-29') AS unique_users_today
 FROM activity WHERE activity_type = 'LOGIN' AND created_at >= TIMESTAMP '2024-01-22'""")
def activity_stats(spark, sf) -> DataFrame:
    return stats.activity_stats(activity(spark, sf), ts("2024-01-29 13:45:00"))


@query(f"""WITH {_ACTIVITY}, hit AS (SELECT * FROM activity WHERE regexp_matches(user_email, 'u1.*@mail', 'i')
  AND activity_type = 'LOGIN' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')
SELECT event_id, user_email, (SELECT count(*) FROM hit) AS total, CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size,
 CAST(ceil((SELECT count(*) FROM hit) / 50.0) AS BIGINT) AS total_pages, (SELECT count(*) FROM hit) > 100 AS has_next
 FROM hit ORDER BY created_at DESC, event_id LIMIT 50 OFFSET 50""")
def activity_page(spark, sf) -> DataFrame:
    hits = activity(spark, sf).filter(W.every(
        W.email_like("u1.*@mail"), W.matching(activity_type="LOGIN"),
        W.in_range("created_at", "2024-01-05", "2024-01-20")))
    out = paging.paged(hits.select("event_id", "user_email", "created_at"),
                       [F.col("created_at").desc(), F.col("event_id")], 2, 50)
    return out.drop("created_at")


@query(f"WITH {_ACTIVITY} SELECT activity_type, count(*) AS n FROM activity WHERE created_at >= TIMESTAMP '2024-01-15' GROUP BY 1")
def activity_retention(spark, sf) -> DataFrame:
    return stats.count_by(stats.unexpired(activity(spark, sf), ts("2025-01-14")), "activity_type")


@query(f"""WITH {_ACTIVITY} SELECT activity_type AS value, count(*) AS rows FROM activity
 WHERE activity_type NOT IN ('LOGIN', 'LOGOUT') GROUP BY 1""")
def domain_audit(spark, sf) -> DataFrame:
    return quality.outside_domain(activity(spark, sf), "activity_type", fixed.ACTIVITY_TYPES)


@query("""SELECT user_id AS task_id, event_id, least(100, greatest(0, CAST(floor(value * 2) AS INT))) AS pct FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100""")
def keep_last_100(spark, sf) -> DataFrame:
    lines = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts",
                                              clamp(F.floor(F.col("value") * 2).cast("int"), 0, 100).alias("pct"))
    kept = paging.last_rows(lines, "task_id", [F.col("ts").desc(), F.col("event_id").desc()], fixed.PROGRESS_LINES)
    return kept.select("task_id", "event_id", "pct")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) FILTER (true) IS NOT NULL AS seen
 FROM events GROUP BY 1""")
def latest_per_user(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("last_type"))
    return latest_per_key(rows, "user_id", ["ts", "event_id"]).select("user_id", "last_type", F.lit(True).alias("seen"))


@query("""SELECT o_orderkey, 1 AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def in_key_list(spark, sf) -> DataFrame:
    """Membership in a key list of any size, as a semi join."""
    keys = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return W.in_list(table(spark, sf, "orders"), keys, "o_custkey").select("o_orderkey", F.lit(1).alias("rank"))
