"""Filters over the stored collections. Each returns a ``Column`` predicate that
Catalyst can push to the scan."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed
from shelfdelta.functions.text import country_code


def alive(tombstone: str = "deleted_at") -> Column:
    return F.col(tombstone).isNull()


def every(*conds: Column | None) -> Column:
    """All of the given conditions; absent ones are skipped."""
    present = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def same_source(source: str | None, field: str = "source") -> Column | None:
    """Equality on the normalised source name; none or blank means no filter."""
    name = (source or "").strip().lower()
    return F.col(field) == name if name else None


def in_range(field: str, start: datetime | str | None = None,
             end: datetime | str | None = None, dtype: str = "timestamp_ntz") -> Column | None:
    """Inclusive at both ends."""
    conds = []
    if start is not None:
        conds.append(F.col(field) >= F.lit(start).cast(dtype))
    if end is not None:
        conds.append(F.col(field) <= F.lit(end).cast(dtype))
    return every(*conds) if conds else None


def matching(**values) -> Column:
    """Equality on every argument that is not none."""
    return every(*[F.col(k) == v for k, v in values.items() if v is not None])


def email_like(pattern: str, field: str = "user_email") -> Column:
    return F.col(field).rlike("(?i)" + pattern)


def open_status(field: str = "status") -> Column:
    return ~F.col(field).isin(fixed.TERMINAL_STATUSES)


def terminal_status(field: str = "status") -> Column:
    return F.col(field).isin(fixed.TERMINAL_STATUSES)


def allowed_country(field: str = "country", allowed: list[str] | None = None) -> Column:
    return country_code(F.col(field)).isin(allowed or fixed.ALLOWED_COUNTRIES)


def sitemap_priority(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.8))


def sane_tier(t: Column) -> Column:
    """A real price and a quantity of at least two."""
    return (t["quantity"] >= 2) & t["unit_price"].between(0.001, 10000)


def in_list(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Membership in a key table as a semi join; the list may be of any size."""
    return df.join(keys.select(on), on, "left_semi")


def products_filter(source: str | None = None, start=None, end=None) -> Column:
    """Alive products of a source, updated inside the range."""
    return every(same_source(source), in_range("updated_at", start, end), alive())


def results_filter(source: str | None = None, start=None, end=None) -> Column:
    """Result envelopes carry ``site`` and have no tombstones."""
    return every(same_source(source, "site"), in_range("created_at", start, end))


def changes_filter(source: str | None = None, task_id: str | None = None,
                   change_type: str | None = None, start=None, end=None) -> Column:
    return every(same_source(source), matching(task_id=task_id, change_type=change_type),
                 in_range("created_at", start, end))


def task_request_problem(site: str = "site", retries: str = "max_retries") -> Column:
    """Why a task request is invalid, or null: a site is required, retries are 0 to 10."""
    return (F.when(F.col(site).isNull() | (F.col(site) == ""), "site is required")
            .when(~F.coalesce(F.col(retries), F.lit(3)).between(0, 10), "max_retries outside 0-10"))
