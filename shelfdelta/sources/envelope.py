"""Result envelopes and paged API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed


def _list_at(data: Column, field: str) -> Column:
    return F.try_variant_get(data, f"$.{field}", "array<variant>")


def _shape(data: Column) -> Column:
    """``[``, ``{`` or something else, from the variant's schema."""
    return F.substring(F.schema_of_variant(data), 1, 3)


def storage_products(data: Column) -> Column:
    """The products of an envelope on the way into storage.

    The first of products / suppliers / items / results that is a list; else the
    object itself when it looks like a product; a list as it is; else nothing.
    """
    v = F.try_parse_json(data)
    hinted = F.arrays_overlap(F.coalesce(F.json_object_keys(data), F.array().cast("array<string>")),
                              F.array(*[F.lit(f) for f in fixed.PRODUCT_HINT_FIELDS]))
    listed = F.coalesce(*[_list_at(v, f) for f in ("products", "suppliers", "items", "results")])
    return (F.when(_shape(v) == "ARR", F.try_variant_get(v, "$", "array<variant>"))
            .when(listed.isNotNull(), listed)
            .when(hinted, F.array(v))
            .otherwise(F.array().cast("array<variant>")))


def export_products(data: Column) -> Column:
    """The products of an envelope on the way out: a non-empty products list, else a
    non-empty suppliers list, else the object itself; a list as it is."""
    v = F.try_parse_json(data)
    filled = lambda f: F.when(F.size(_list_at(v, f)) > 0, _list_at(v, f))
    listed = F.coalesce(filled("products"), filled("suppliers"))
    return (F.when(_shape(v) == "ARR", F.try_variant_get(v, "$", "array<variant>"))
            .when(_shape(v) == "OBJ", F.coalesce(listed, F.array(v)))
            .otherwise(F.array().cast("array<variant>")))


def explode_products(envelopes: DataFrame, products: Column) -> DataFrame:
    """One row per product with its JSON text; the envelope's other columns stay."""
    kept = [c for c in envelopes.columns if c != "data"]
    return envelopes.select(*kept, F.posexplode(products).alias("pos", "_product")).select(
        *kept, "pos", F.to_json("_product").alias("doc"))


def page_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """The ``data`` items of every readable API page, in page order; pages that do
    not parse or have no list are dropped."""
    kept = [c for c in pages.columns if c != body]
    items = F.try_variant_get(F.try_parse_json(F.col(body)), "$.data", "array<variant>")
    return pages.select(*kept, F.posexplode(items).alias("pos", "_item")).select(
        *kept, "pos", F.to_json("_item").alias("doc"))


def failed_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """The pages ``page_items`` drops."""
    items = F.try_variant_get(F.try_parse_json(F.col(body)), "$.data", "array<variant>")
    return pages.filter(items.isNull())
