"""The scraper registry as a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def listing(registry: DataFrame, active_only: bool = True) -> DataFrame:
    """Registry rows with the shown metadata fields flattened."""
    rows = registry.filter("status = 'active'") if active_only else registry
    return rows.select("site_id", "name", F.coalesce("base_url", F.lit("")).alias("base_url"),
                       F.coalesce("status", F.lit("active")).alias("status"),
                       F.coalesce("metadata.description", F.lit("")).alias("description"),
                       F.coalesce("metadata.tags", F.array().cast("array<string>")).alias("tags"))


def sync(stored: DataFrame, declared: DataFrame, at: Column) -> DataFrame:
    """Declared rows win, stored rows no longer declared are dropped, creation
    times of known rows stay."""
    known = stored.select("site_id", F.col("created_at").alias("_created"))
    return declared.join(known, "site_id", "left").select(
        "site_id", *[c for c in declared.columns if c not in ("site_id", "created_at", "updated_at")],
        F.coalesce("_created", "created_at").alias("created_at"), at.alias("updated_at"))


def stale(stored: DataFrame, declared: DataFrame) -> DataFrame:
    return stored.join(declared.select("site_id"), "site_id", "left_anti")


def set_status(registry: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Apply ``(site_id, new_status)`` rows; only status and update time change."""
    joined = registry.join(changes.select("site_id", "new_status"), "site_id", "left")
    hit = F.col("new_status").isNotNull()
    values = {"status": F.coalesce("new_status", "status"),
              "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in registry.columns])
