"""Change classification between a stored catalog and a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed, keys, payload as P
from shelfdelta.functions.text import iso_text, or_blank

KEY = "product_key"


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key, the one that sorts last on ``order``.

    An aggregate rather than a window: copies of a key collapse on the map side,
    so a key that holds a third of the rows never travels as a whole.
    """
    on = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in on]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*on).agg(packed).select(*on, "row.*").select(*df.columns)


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    on = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in on]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*on).agg(packed).select(*on, "row.*").select(*df.columns)


def keyed(documents: DataFrame, source: str | Column, json: str = "doc",
          hidden: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Raw JSON product documents as ``(source, product_key, payload, data_hash)``.

    The source is normalised before hashing so that a producer's upper-case name
    and the stored one do not read as a change.
    """
    name = F.lit(source.strip().lower()) if isinstance(source, str) else keys.source_name(source)
    kept = keep or []
    rows = documents.select(*kept, name.alias("source"), P.parse(F.col(json)).alias("raw"))
    stamped = F.map_concat(F.map_filter("raw", lambda k, v: k != "source"),
                           F.create_map(F.lit("source"), P.quoted(F.col("source"))))
    rows = rows.filter(F.col("raw").isNotNull()).select(*kept, "source", stamped.alias("payload"))
    text = P.text_value
    body = F.col("payload")
    return rows.select(
        *kept, "source",
        keys.product_key(F.col("source"), text(body, "product_id", "sku"), None,
                         text(body, "product_url", "url"), None, text(body, "name")).alias(KEY),
        "payload",
        P.content_hash(body, hidden).alias("data_hash"))


def unreadable(documents: DataFrame, json: str = "doc") -> DataFrame:
    """The rows ``keyed`` leaves out: texts that are no JSON object, and nulls."""
    return documents.filter(P.parse(F.col(json)).isNull())


def change_type(old_key: Column, new_key: Column, old_hash: Column, new_hash: Column,
                old_alive: Column) -> Column:
    """added / updated / unchanged / deleted; null for a row that was already gone."""
    return (F.when(old_key.isNull(), "added")
            .when(new_key.isNotNull() & ~old_hash.eqNullSafe(new_hash), "updated")
            .when(new_key.isNotNull(), "unchanged")
            .when(old_alive, "deleted"))


def classify(state: DataFrame, batch: DataFrame, partial: bool = False) -> DataFrame:
    """Key, both hashes and the change type of every key, in one full outer join.

    Only keys, hashes and the tombstone travel through the shuffle. A stored row
    that is tombstoned still counts as known, so an identical reappearance is
    ``unchanged`` with ``revived`` set. A partial run deletes nothing.
    """
    old = state.select(KEY, F.col("source").alias("old_source"), F.col("data_hash").alias("old_hash"),
                       F.col("deleted_at").alias("old_deleted_at"), F.lit(True).alias("in_old"))
    new = batch.select(KEY, F.col("source").alias("new_source"), F.col("data_hash").alias("new_hash"),
                       F.lit(True).alias("in_new"))
    kind = change_type(F.col("in_old"), F.col("in_new"), F.col("old_hash"), F.col("new_hash"),
                       F.col("old_deleted_at").isNull())
    out = old.join(new, KEY, "full_outer").select(
        KEY, F.coalesce("new_source", "old_source").alias("source"), kind.alias("change_type"),
        "old_hash", "new_hash",
        (F.col("in_new").isNotNull() & F.col("old_deleted_at").isNotNull()).alias("revived"))
    kept = F.col("change_type").isNotNull()
    return out.filter(kept & (F.col("change_type") != "deleted") if partial else kept)


def added(state: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(state.select(KEY), KEY, "left_anti")


def matched(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys on both sides with their change type."""
    old = state.select(KEY, F.col("data_hash").alias("old_hash"))
    same = F.col("old_hash").eqNullSafe(F.col("data_hash"))
    return batch.join(old, KEY).withColumn("change_type", F.when(same, "unchanged").otherwise("updated"))


def missing(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Alive stored rows the run did not see."""
    return state.filter(F.col("deleted_at").isNull()).join(batch.select(KEY), KEY, "left_anti")


def audit_columns(kind: Column, old: Column, new: Column, hidden: list[str] | None,
            side_limit: int | None, field_limit: int | None) -> list[Column]:
    named = F.when(kind == "deleted", old).otherwise(new)
    updated = kind == "updated"
    return [
        P.text_value(named, "product_id", "sku").alias("product_id"),
        P.text_value(named, "name", "title").alias("product_name"),
        F.when(kind != "deleted", P.cap(new, side_limit)).alias("new_data"),
        F.when(kind != "added", P.cap(old, side_limit)).alias("old_data"),
        F.when(updated, P.cap_diff(P.diff(old, new, hidden), field_limit)).alias("field_changes"),
        F.when(kind == "added", F.col("new_hash")).alias("data_hash"),
        F.when(updated, F.col("old_hash")).alias("old_hash"),
        F.when(updated, F.col("new_hash")).alias("new_hash"),
    ]


def change_records(state: DataFrame, batch: DataFrame, run_ts: Column, task_id: str | None = None,
                   session_id: str | None = None, partial: bool = False,
                   hidden: list[str] | None = None,
                   side_limit: int | None = None, field_limit: int | None = None) -> DataFrame:
    """Audit rows for added, updated and deleted keys; with limits, larger payloads and values become stubs.

    Late materialisation: the hash-only classification runs first and payloads are
    then fetched for the changed keys alone. AQE broadcasts the changed-key side
    while it is small and a runtime bloom filter thins the payload scans when not.
    """
    changed = classify(state, batch, partial).filter(F.col("change_type") != "unchanged")
    new_body = batch.select(KEY, F.col("payload").alias("new_payload"))
    old_body = state.select(KEY, F.col("payload").alias("old_payload"))
    rows = changed.join(new_body, KEY, "left").join(old_body, KEY, "left")
    return rows.select(
        "source", F.lit(task_id).cast("string").alias("task_id"),
        F.lit(session_id).cast("string").alias("session_id"), "change_type", KEY,
        *audit_columns(F.col("change_type"), F.col("old_payload"), F.col("new_payload"), hidden,
                 side_limit, field_limit),
        run_ts.alias("created_at"))


def changed_fields(records: DataFrame) -> DataFrame:
    """One row per field an update added, removed or changed."""
    parts = F.col("field_changes")
    entries = F.concat(
        F.transform(F.map_entries(parts["added_fields"]), lambda e: F.struct(
            F.lit("added").alias("kind"), e["key"].alias("field"),
            F.lit(None).cast("string").alias("old_value"), e["value"].alias("new_value"))),
        F.transform(F.map_entries(parts["removed_fields"]), lambda e: F.struct(
            F.lit("removed").alias("kind"), e["key"].alias("field"),
            e["value"].alias("old_value"), F.lit(None).cast("string").alias("new_value"))),
        F.transform(F.map_entries(parts["changed_fields"]), lambda e: F.struct(
            F.lit("changed").alias("kind"), e["key"].alias("field"),
            e["value"]["old_value"].alias("old_value"), e["value"]["new_value"].alias("new_value"))))
    return records.filter(parts.isNotNull()).select("source", KEY, F.inline(entries))


def change_log(records: DataFrame) -> DataFrame:
    """The 11-column audit view: added rows show the new data, deleted rows the old
    data, updated rows their differences."""
    kind, parts = F.col("change_type"), F.col("field_changes")
    bare = parts.isNull()
    hide_id = lambda m: F.map_filter(m, lambda k, v: k != "_id")
    values = {
        "created_at": or_blank(iso_text(F.col("created_at"))),
        "added_fields": F.when((kind == "added") & bare, P.fields_text(hide_id(F.col("new_data"))))
                         .when((kind == "deleted") & bare, F.lit(""))
                         .otherwise(P.fields_text(parts["added_fields"])),
        "removed_fields": F.when((kind == "deleted") & bare, P.fields_text(hide_id(F.col("old_data"))))
                           .when((kind == "added") & bare, F.lit(""))
                           .otherwise(P.fields_text(parts["removed_fields"])),
        "changed_fields": F.when(kind.isin("added", "deleted") & bare, F.lit(""))
                           .otherwise(P.changes_text(parts["changed_fields"])),
    }
    return records.select(*[values.get(c, F.col(c)).alias(c) for c in fixed.CHANGE_LOG_COLUMNS])


def key_difference(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def key_intersection(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return left.select(key).intersect(right.select(key))
