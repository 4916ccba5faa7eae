"""Keyed upsert of a run into the stored catalog, tombstones and revival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import payload as P
from shelfdelta.operators.diff import KEY, audit_columns, change_type
from shelfdelta.schemas import CATALOG

STATE_COLUMNS = ["source", KEY, "payload", "data_hash", "created_at", "updated_at", "deleted_at",
                 "deleted_by_task", "last_task_id", "scrape_count"]


def empty_state(batch: DataFrame) -> DataFrame:
    """A state with no rows, typed to take the batch."""
    return batch.sparkSession.createDataFrame([], CATALOG)


def apply_run(state: DataFrame, batch: DataFrame, run_ts: Column, task_id: str | None = None,
              partial: bool = False) -> DataFrame:
    """Every key's row after the run, with what happened to it.

    One full outer join carries both payloads, so the new state, the change
    records and the counters of a run all come from a single shuffle of each side.
    The batch must hold one row per key (``latest_per_key``).

    ``change_type`` is null for rows that were already tombstoned, and also for
    rows a partial run did not see.
    """
    o, n = state.alias("o"), batch.select(KEY, "source", "payload", "data_hash").alias("n")
    old_key, new_key = F.col(f"o.{KEY}"), F.col(f"n.{KEY}")
    seen = new_key.isNotNull()
    kind = change_type(old_key, new_key, F.col("o.data_hash"), F.col("n.data_hash"),
                       F.col("o.deleted_at").isNull() & F.lit(not partial))
    dropped = ~seen & F.col("o.deleted_at").isNull() & F.lit(not partial)
    task = F.lit(task_id).cast("string")
    joined = o.join(n, old_key == new_key, "full_outer")
    return joined.select(
        F.coalesce("n.source", "o.source").alias("source"),
        F.coalesce(new_key, old_key).alias(KEY),
        P.merge(F.col("o.payload"), F.col("n.payload")).alias("payload"),
        F.coalesce("n.data_hash", "o.data_hash").alias("data_hash"),
        F.coalesce(F.col("o.created_at"), run_ts).alias("created_at"),
        F.when(seen, run_ts).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(dropped, run_ts).when(~seen, F.col("o.deleted_at")).alias("deleted_at"),
        F.when(dropped, task).otherwise(F.col("o.deleted_by_task")).alias("deleted_by_task"),
        F.when(seen, F.coalesce(task, F.col("o.last_task_id")))
         .otherwise(F.col("o.last_task_id")).alias("last_task_id"),
        (F.coalesce("o.scrape_count", F.lit(0)) + seen.cast("bigint")).cast("bigint").alias("scrape_count"),
        kind.alias("change_type"),
        F.col("o.payload").alias("old_payload"), F.col("n.payload").alias("new_payload"),
        F.col("o.data_hash").alias("old_hash"), F.col("n.data_hash").alias("new_hash"),
        (seen & F.col("o.deleted_at").isNotNull()).alias("revived"),
        seen.alias("active"))


def decide(index: DataFrame, batch: DataFrame, run_ts: Column, number: int, task_id: str | None = None,
           partial: bool = False, hidden: list[str] | None = None) -> DataFrame:
    """What a run does with every key, out of keys, hashes and stamps alone.

    ``index`` has the rows of ``schemas.INDEX``, ``batch`` one row per key with source, data_hash and
    stamps; ``number`` is that of the run's commit. Gives the new index rows with change_type,
    both hashes, stamps and payload numbers, active and revived. No payload is looked at.
    """
    o, n = index.alias("o"), batch.alias("n")
    old_key, new_key = F.col(f"o.{KEY}"), F.col(f"n.{KEY}")
    seen = new_key.isNotNull()
    kind = change_type(old_key, new_key, F.col("o.data_hash"), F.col("n.data_hash"), F.col("o.deleted_at").isNull() & F.lit(not partial))
    dropped = ~seen & F.col("o.deleted_at").isNull() & F.lit(not partial)
    task, commit = F.lit(task_id).cast("string"), F.lit(number).cast("bigint")
    fresh = seen & ~F.col("o.data_hash").eqNullSafe(F.col("n.data_hash"))
    return o.join(n, old_key == new_key, "full_outer").select(
        F.coalesce("n.source", "o.source").alias("source"), F.coalesce(new_key, old_key).alias(KEY),
        F.coalesce("n.data_hash", "o.data_hash").alias("data_hash"),
        # Stamps that this run does not hide go over into the payload that it writes.
        P.merge(F.when(fresh, P.stamps(F.col("o.stamps"), hidden)).otherwise(F.col("o.stamps")), F.col("n.stamps")).alias("stamps"),
        F.coalesce(F.col("o.created_at"), run_ts).alias("created_at"),
        F.when(seen, run_ts).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(dropped, run_ts).when(~seen, F.col("o.deleted_at")).alias("deleted_at"),
        F.when(dropped, task).otherwise(F.col("o.deleted_by_task")).alias("deleted_by_task"),
        F.when(seen, F.coalesce(task, F.col("o.last_task_id"))).otherwise(F.col("o.last_task_id")).alias("last_task_id"),
        (F.coalesce("o.scrape_count", F.lit(0)) + seen.cast("bigint")).cast("bigint").alias("scrape_count"),
        F.when(fresh | old_key.isNull(), commit).otherwise(F.col("o.written")).alias("written"),
        F.when(seen, commit).otherwise(F.col("o.seen_in")).alias("seen_in"),
        kind.alias("change_type"), F.col("o.data_hash").alias("old_hash"), F.col("n.data_hash").alias("new_hash"),
        F.col("o.stamps").alias("old_stamps"), F.col("n.stamps").alias("new_stamps"), F.col("o.written").alias("old_written"),
        (seen & F.col("o.deleted_at").isNotNull()).alias("revived"), seen.alias("active"))


def fetch(decided: DataFrame, batch: DataFrame, stored: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """The changed keys of a run with ``old_payload``, ``new_payload`` and the stored ``payload``.

    Payloads join on the keys that need them alone: the batch's for added and updated keys, by key and
    hash (copies of a hash differ in stamps only), the stored ones for updated and deleted keys.
    """
    changed = decided.filter(F.col("change_type").isin("added", "updated", "deleted"))
    wanted = changed.filter(F.col("change_type") != "deleted").select(KEY, F.col("new_hash").alias("data_hash"))
    new = batch.join(wanted, [KEY, "data_hash"], "left_semi").groupBy(KEY).agg(F.any_value("payload").alias("new_body"))
    kept = changed.filter(F.col("change_type") != "added").select(KEY, F.col("old_written").alias("written"))
    old = stored.join(kept, [KEY, "written"], "left_semi").select(KEY, F.col("payload").alias("old_body"))
    # Payloads grow out of small files: the size the planner expects of them says nothing, so they are merged, never broadcast.
    rows = changed.join(new.hint("merge"), KEY, "left").join(old.hint("merge"), KEY, "left")
    return rows.select(
        *changed.columns,
        P.merge(P.merge(F.col("old_body"), P.without(F.col("old_stamps"), hidden)), F.col("new_body")).alias("payload"),
        P.merge(F.col("old_body"), F.col("old_stamps")).alias("old_payload"), P.merge(F.col("new_body"), F.col("new_stamps")).alias("new_payload"))


def new_state(applied: DataFrame) -> DataFrame:
    return applied.select(*STATE_COLUMNS)


def records_of(applied: DataFrame, run_ts: Column, task_id: str | None = None,
               session_id: str | None = None, hidden: list[str] | None = None,
               side_limit: int | None = None, field_limit: int | None = None) -> DataFrame:
    """The audit rows of an applied run, without another join."""
    rows = applied.filter(F.col("change_type").isin("added", "updated", "deleted"))
    return rows.select(
        "source", F.lit(task_id).cast("string").alias("task_id"),
        F.lit(session_id).cast("string").alias("session_id"), "change_type", KEY,
        *audit_columns(F.col("change_type"), F.col("old_payload"), F.col("new_payload"), hidden,
                 side_limit, field_limit),
        run_ts.alias("created_at"))


def run_counters(applied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Storage and change counters of a run, per group or overall."""
    kind = F.col("change_type")
    gone = F.count_if(kind == "deleted")
    return applied.groupBy(*(by or [])).agg(
        F.count_if(kind == "added").alias("inserted"),
        F.count_if(F.col("active") & (kind != "added")).alias("stored_again"),
        F.count_if(kind == "added").alias("added"),
        F.count_if(kind == "updated").alias("updated"),
        gone.alias("deleted"),
        F.count_if(kind == "unchanged").alias("unchanged"),
        gone.alias("soft_deleted"),
        F.count_if("revived").alias("revived"),
        F.count_if("active").alias("active_keys"))


def tombstone_missing(state: DataFrame, active_keys: DataFrame, run_ts: Column,
                      task_id: str | None = None) -> DataFrame:
    """Soft-delete every alive row whose key is not in an explicit active set."""
    marked = active_keys.select(KEY).distinct().withColumn("is_active", F.lit(True))
    gone = F.col("is_active").isNull() & F.col("deleted_at").isNull()
    return state.join(marked, KEY, "left").select(
        *[c for c in STATE_COLUMNS if c not in ("deleted_at", "deleted_by_task")],
        F.when(gone, run_ts).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(gone, F.lit(task_id).cast("string")).otherwise(F.col("deleted_by_task"))
         .alias("deleted_by_task"),
        gone.alias("newly_deleted")).select(*STATE_COLUMNS, "newly_deleted")
