"""Typed product documents out of JSON texts and stored payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfdelta.functions import payload as P
from shelfdelta.functions.binding import let
from shelfdelta.schemas import PRODUCT_DOCUMENT

# What the catalog keeps in columns of its own.
_KEPT_BY_STORE = ("source", "created_at", "updated_at", "deleted_at")


def _is_plain(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _read(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def product(json: Column, ddl: str = PRODUCT_DOCUMENT) -> Column:
    """A JSON product text as a struct of ``ddl``.

    Numbers and flags are read as texts first, so ``"1599"`` counts as 1599 and a value
    that is none gives null, never a failed row.
    """
    fields = T.StructType.fromDDL(ddl).fields
    loose = T.StructType([T.StructField(f.name, T.StringType() if _is_plain(f.dataType) else f.dataType) for f in fields])
    return let(F.from_json(json, loose), lambda d: F.struct(*[
        (_read(d[f.name], f.dataType) if _is_plain(f.dataType) else d[f.name]).alias(f.name) for f in fields]))


def products(catalog: DataFrame, ddl: str = PRODUCT_DOCUMENT) -> DataFrame:
    """Stored rows as product documents, for sheets, statistics and pages.

    Source and time stamps are those of the store. Reads no column but these and the payload.
    """
    names = [f.name for f in T.StructType.fromDDL(ddl).fields if f.name not in _KEPT_BY_STORE]
    rows = catalog.select("product_key", *_KEPT_BY_STORE, product(P.canonical_text(F.col("payload")), ddl).alias("_p"))
    return rows.select("product_key", *_KEPT_BY_STORE, *[F.col(f"_p.`{n}`") for n in names])
