"""Identity: source names, product keys, variant keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfdelta.functions.text import first_filled, or_blank, strip


def source_name(c: Column) -> Column:
    """Trimmed and lower-cased; empty means no source."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def product_key(source: Column, product_id: Column | None = None, sku: Column | None = None,
                product_url: Column | None = None, url: Column | None = None,
                name: Column | None = None) -> Column:
    """``source:`` and the first identifier present, else a digest of the name."""
    given = [c for c in (product_id, sku, product_url, url) if c is not None]
    digest = F.left(F.md5(or_blank(name) if name is not None else F.lit("")), F.lit(16))
    identity = F.coalesce(first_filled(*given), digest) if given else digest
    return F.concat(source, F.lit(":"), identity)


def variant_key(sku: Column) -> Column:
    return F.left(F.sha1(sku), F.lit(16))
