"""Sorted pages, top-k lists and lookups."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfdelta.functions import predicates as W


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1). ``order`` must end in a unique key.

    Offset and limit run as one bounded top-k (``offset + size`` rows per task), so
    only early pages are cheap; deep pages go through ``page_after``.
    """
    skip = (number - 1) * size
    ordered = df.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(size)


def page_after(df: DataFrame, after: Column, order: list[Column], size: int = 20) -> DataFrame:
    """The page that follows a known last row: a filter and a top-k at any depth."""
    return df.filter(after).orderBy(*order).limit(size)


def page_info(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Total, page count and whether a further page exists, as one row."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).cast("bigint").alias("page"), F.lit(size).cast("bigint").alias("page_size"),
        F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("total_pages"),
        (F.lit(number * size) < F.col("total")).alias("has_next"))


def paged(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page with its totals on every row; the totals are a scalar subquery."""
    totals = page_info(df, number, size).select(F.struct("*").alias("t")).scalar()
    return page(df, order, number, size).withColumn("_t", totals).select("*", "_t.*").drop("_t")


def blueprint_page(products: DataFrame, number: int = 1, size: int = 20, blueprint_id: int | None = None,
                   provider_id: int | None = None, available: bool | None = None, include_deleted: bool = False) -> DataFrame:
    """One page of an API catalog in blueprint order, with optional filters."""
    chosen = products.filter(W.every(
        W.matching(blueprint_id=blueprint_id, provider_id=provider_id, available=available),
        None if include_deleted else W.alive()))
    return page(chosen, [F.col("blueprint_id"), F.col("product_id")], number, size)


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def capped_run(urls: DataFrame, order: list[Column], max_products: int = 0) -> DataFrame:
    """The first ``max_products`` rows (0 means all); a capped run is partial."""
    capped = max_products > 0
    rows = urls.orderBy(*order).limit(max_products) if capped else urls
    return rows.withColumn("is_partial", F.lit(capped))


def last_rows(df: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    """The ``count`` rows per key that come first in ``order``.

    The rank filter lets Spark keep ``count`` rows per key before the shuffle, so
    a key with very many rows does not travel whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= count).drop("_rank")


def lookup(df: DataFrame, owner: str | None = None, **ids) -> DataFrame:
    """A point lookup, with an ownership check where ``owner`` is given."""
    for name, value in ids.items():
        df = df.filter(F.col(name) == value)
    return df.filter(F.col("user_id") == owner) if owner is not None else df


def pages_for(total: int, size: int) -> int:
    return ceil(total / size)
