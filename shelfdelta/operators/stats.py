"""Aggregates over catalog, change log, tasks, activity and registry.

All are one-pass hash aggregates with map-side partials. Distinct counts use
two-level aggregation, so no value set is held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed
from shelfdelta.functions import predicates as W
from shelfdelta.functions.text import day_start, last_days


def change_summary(changes: DataFrame, as_of: Column, source: str | None = None,
                   task_id: str | None = None, days: int = 7) -> DataFrame:
    """One row: changes of the last ``days`` by type, zero where none."""
    recent = changes.filter(W.every(W.same_source(source), W.matching(task_id=task_id),
                                    F.col("created_at") >= last_days(as_of, days)))
    kind = F.col("change_type")
    return recent.agg(F.count_if(kind == "added").alias("added"),
                      F.count_if(kind == "updated").alias("updated"),
                      F.count_if(kind == "deleted").alias("deleted"),
                      F.count("*").alias("total_changes")).select(
        F.lit((source or "").strip().lower()).alias("source"),
        F.lit(days).cast("bigint").alias("period_days"), "*")


def change_stats(changes: DataFrame, as_of: Column | None = None, days: int = 7,
                 source: str | None = None) -> DataFrame:
    """Per source: total and a map of count by change type."""
    recent = W.every(W.same_source(source),
                     F.col("created_at") >= last_days(as_of, days) if as_of is not None else None)
    by_type = changes.filter(recent).groupBy("source", "change_type").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "n"))))
    return by_type.groupBy("source").agg(F.sum("n").alias("total_changes"), pairs.alias("by_type"))


def task_summary(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Counts by status, mean duration of completed tasks, success rate in percent."""
    status = F.col("status")
    counted = tasks.filter(W.matching(user_id=user_id)).agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in fixed.TASK_STATUSES],
        F.avg(F.when(status == "completed", F.col("duration_ms"))).alias("avg_duration_ms"))
    ended = F.col("completed") + F.col("failed") + F.col("cancelled")
    return counted.withColumn(
        "success_rate", F.when(ended > 0, F.col("completed") / ended * 100).otherwise(F.lit(0.0)))


def activity_stats(activity: DataFrame, as_of: Column) -> DataFrame:
    """Logins and failures today, logins of the week, distinct users today."""
    today = day_start(as_of).cast("timestamp_ntz")
    week = today - F.make_interval(days=F.lit(7))
    at, ok = F.col("created_at"), F.col("success")
    recent = activity.filter((F.col("activity_type") == "LOGIN") & (at >= week))
    return recent.agg(
        F.count_if(ok & (at >= today)).alias("today_logins"),
        F.count_if(~ok & (at >= today)).alias("today_failed_logins"),
        F.count_if(ok).alias("week_logins"),
        F.count_distinct(F.when(ok & (at >= today), F.col("user_email"))).alias("unique_users_today"))


def unexpired(activity: DataFrame, as_of: Column, days: int = fixed.ACTIVITY_TTL_DAYS) -> DataFrame:
    """Rows inside the retention time."""
    return activity.filter(F.col("created_at") >= last_days(as_of, days))


def catalog_stats(products: DataFrame, source: str | None = None, include_deleted: bool = False) -> DataFrame:
    """Totals, availability, distinct blueprints and providers, latest update."""
    chosen = W.every(W.same_source(source), None if include_deleted else W.alive())
    return products.filter(chosen).agg(
        F.count("*").alias("total_products"), F.count_if("available").alias("available_products"),
        F.count_distinct("blueprint_id").alias("unique_blueprints"),
        F.count_distinct("provider_id").alias("unique_providers"),
        F.max("updated_at").alias("last_scraped_at"))


def known_sources(products: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct sources of products and result envelopes together."""
    return products.select("source").union(results.select(F.col("site").alias("source"))).distinct()


def export_stats(products: DataFrame, results: DataFrame, source: str | None = None,
                 start=None, end=None, columns: int | None = None) -> DataFrame:
    """One row: alive products, result envelopes, number of sources, sheet width."""
    enveloped = results.filter(W.results_filter(source, start, end)).agg(F.count("*"))
    sources = known_sources(products, results).agg(F.count("*"))
    counted = products.filter(W.products_filter(source, start, end)).agg(
        F.count("*").alias("products_collection_count"))
    return counted.select(
        "products_collection_count", enveloped.scalar().alias("results_collection_count"),
        sources.scalar().alias("available_sources"),
        F.lit(columns or len(fixed.sheet_columns())).cast("bigint").alias("csv_columns_count"))


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def registry_stats(registry: DataFrame) -> DataFrame:
    """Scrapers by status with a ``total`` row."""
    return registry.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("status")).alias("status"), "n")


def active_sites(tasks: DataFrame) -> DataFrame:
    """Sites with at least one task that has not ended."""
    return tasks.filter(W.open_status()).select("site").distinct()
