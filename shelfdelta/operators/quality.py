"""Data-quality audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfdelta.functions import document, payload as P
from shelfdelta.functions.binding import let
from shelfdelta.schemas import PRODUCT_DOCUMENT, TIER

PROBLEMS = "array<struct<column:string,reason:string>>"

# Declared unique keys.
UNIQUE_KEYS = {
    "results": ["task_id"], "registry": ["site_id"], "users": ["email"],
    "settings": ["key"], "api_keys": ["key_credential"],
}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def outside_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of a column that are not in its allowed set, with their counts."""
    return df.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(
        F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def hash_agreement(catalog: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Stored hashes against recomputed ones, per source."""
    same = F.col("data_hash").eqNullSafe(P.content_hash(F.col("payload"), hidden))
    return catalog.groupBy("source").agg(F.count("*").alias("checked"),
                                         F.count_if(~same).alias("disagreeing"))


def document_problems(json: Column, ddl: str = PRODUCT_DOCUMENT) -> Column:
    """What keeps a JSON product text from being exported as it stands: ``array<struct<column,reason>>``.

    A text that is no JSON object, a plain field whose value does not read as its type, a list or
    object field of another shape, tiers without a positive quantity or with a negative or missing price.
    Absent, null and blank values are no problem.
    """
    fields = T.StructType.fromDDL(ddl).fields
    problem = lambda column, reason: F.named_struct(F.lit("column"), F.lit(column), F.lit("reason"), F.lit(reason))
    where = lambda test, column, reason: F.when(F.coalesce(test, F.lit(False)), problem(column, reason))

    def of_document(d: Column) -> Column:
        payload, typed = d["payload"], d["typed"]
        found = []
        for f in fields:
            held = F.try_element_at(payload, F.lit(f.name))
            filled = held.isNotNull() & ~F.lower(F.trim(held, F.lit('" '))).isin("null", "")
            plain = isinstance(f.dataType, (T.NumericType, T.BooleanType))
            if plain or isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
                found.append(where(filled & typed[f.name].isNull(), f.name, f"no {f.dataType.simpleString()}" if plain else "other shape"))
        tiers = F.coalesce(typed["base_tiers"], F.array().cast(f"array<{TIER}>"))
        found.append(where(F.exists(tiers, lambda t: F.coalesce(t["quantity"], F.lit(0)) < 1), "base_tiers", "quantity"))
        found.append(where(F.exists(tiers, lambda t: F.coalesce(t["unit_price"], F.lit(-1.0)) < 0), "base_tiers", "price"))
        return F.when(payload.isNull(), F.array(problem("document", "no JSON object"))).otherwise(F.array_compact(F.array(*found)))

    return let(F.struct(P.parse(json).alias("payload"), document.product(json, ddl).alias("typed")), of_document).cast(PROBLEMS)
