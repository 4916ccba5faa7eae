"""Quantity tiers. Product documents are nested, so all of this works inside the
row with higher-order functions: no shuffle, whatever a product holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import keys
from shelfdelta.functions.binding import let
from shelfdelta.functions.text import blank_to_null, dashed, or_blank, price_text, quantity_text
from shelfdelta.functions.urls import slug
from shelfdelta.schemas import TIER, VARIANT


def or_empty(items: Column, dtype: str) -> Column:
    return F.coalesce(items, F.array().cast(dtype))


PRICING = "array<struct<shape:string,size:string,print_method:string,quantity:bigint,unit_price:double>>"


def pricing_of(df: DataFrame) -> Column:
    """The ``pricing`` list with exactly the fields the expansions read; an empty
    list where the table has none."""
    kind = {f.name: f.dataType for f in df.schema.fields}.get("pricing")
    if kind is None:
        return F.array().cast(PRICING)
    have = kind.elementType.names
    pick = lambda e, n, t: (e[n] if n in have else F.lit(None)).cast(t).alias(n)
    return or_empty(F.transform("pricing", lambda e: F.struct(
        pick(e, "shape", "string"), pick(e, "size", "string"), pick(e, "print_method", "string"),
        pick(e, "quantity", "bigint"), pick(e, "unit_price", "double"))), PRICING)


def by_quantity(entries: Column) -> Column:
    """Stable sort on quantity: equal quantities keep their order."""
    placed = F.transform(entries, lambda e, i: F.struct(
        F.coalesce(e["quantity"], F.lit(0)).alias("q"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda p: p["e"])


def _first_of_runs(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The first entry of every run of equal entries in a sorted list."""
    return let(ordered, lambda es: F.filter(es, lambda e, i: (i == 0) | ~same(F.get(es, i - 1), e)))


def last_price_wins(entries: Column) -> Column:
    """One tier per quantity, the last listed price, in quantity order."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(
        e["quantity"].alias("quantity"), (-i).alias("place"), e["unit_price"].alias("unit_price"))))
    kept = _first_of_runs(placed, lambda a, b: a["quantity"] == b["quantity"])
    return F.transform(kept, lambda e: F.struct(
        e["quantity"].alias("quantity"), e["unit_price"].alias("unit_price")))


def median_of(prices: Column) -> Column:
    """Median of a list, the middle pair averaged; 0 for an empty list."""
    def middle(ordered: Column) -> Column:
        count = F.size(ordered)
        low = F.get(ordered, F.floor((count - 1) / 2).cast("int"))
        high = F.get(ordered, F.floor(count / 2).cast("int"))
        return F.when(count > 0, (low + high) / 2).otherwise(F.lit(0.0))
    return let(F.array_sort(prices), middle)


def flagged(tiers: Column) -> Column:
    """Sample and outlier flags; nothing is dropped.

    A quantity of one is a sample when two or more tiers start at 25. A price above
    ten times the median of the other prices is an outlier.
    """
    def with_rule(b: Column) -> Column:
        sample = lambda t: (t["quantity"] == 1) & b["bulk"]
        return F.transform(b["tiers"], lambda t: F.struct(
            t["quantity"].alias("quantity"), t["unit_price"].alias("unit_price"),
            sample(t).alias("is_sample"),
            ((b["middle"] > 0) & (t["unit_price"] > b["middle"] * 10)).alias("is_outlier")))

    def with_bulk(b: Column) -> Column:
        prices = F.transform(F.filter(b["tiers"], lambda t: ~((t["quantity"] == 1) & b["bulk"])),
                             lambda t: t["unit_price"])
        return let(F.struct(b["tiers"].alias("tiers"), b["bulk"].alias("bulk"), median_of(prices).alias("middle")),
                   with_rule)

    return let(tiers, lambda ts: let(F.struct(
        ts.alias("tiers"), (F.size(F.filter(ts, lambda t: t["quantity"] >= 25)) >= 2).alias("bulk")), with_bulk))


def ordinals(tiers: Column, flag: str) -> Column:
    """1-based positions of flagged tiers, comma-joined."""
    marks = F.transform(tiers, lambda t, i: F.when(t[flag], (i + 1).cast("string")))
    return or_blank(F.array_join(F.filter(marks, lambda m: m.isNotNull()), ","))


def grouped(entries: Column, *fields: str, limit: int | None = None) -> Column:
    """Price entries by their ``fields``, groups in first-seen order, each
    sorted on quantity: ``array<struct<group:struct<…>, tiers:array<…>>>``."""
    key = lambda e: F.struct(*[e[f].alias(f) for f in fields])

    def split(es: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(es, key)), lambda g: let(
            by_quantity(F.filter(es, lambda e: key(e) == g)), lambda members: F.struct(
                g.alias("group"), (F.slice(members, 1, limit) if limit else members).alias("tiers"),
                F.get(members, F.lit(0))["quantity"].alias("min_quantity"))))

    return let(entries, split)


def shape_size_groups(pricing: Column, limit: int | None = None) -> Column:
    """Groups on (shape, size); a missing shape is ``Default``, a missing size ''."""
    entries = F.transform(pricing, lambda e: F.struct(
        F.coalesce(e["shape"], F.lit("Default")).alias("shape"), or_blank(e["size"]).alias("size"),
        e["quantity"].alias("quantity"), e["unit_price"].alias("unit_price")))
    return grouped(entries, "shape", "size", limit=limit)


def method_groups(pricing: Column, limit: int | None = None) -> Column:
    """Groups on print method; a missing or empty one is ``Standard``."""
    entries = F.transform(pricing, lambda e: F.struct(
        F.coalesce(blank_to_null(e["print_method"]), F.lit("Standard")).alias("print_method"),
        e["quantity"].alias("quantity"), e["unit_price"].alias("unit_price")))
    return grouped(entries, "print_method", limit=limit)


def legacy_variants(pricing: Column, product_url: Column) -> Column:
    """Variants for documents of the first schema version, one per print method."""
    groups = method_groups(or_empty(pricing, PRICING), limit=None)
    nothing = F.lit(None)

    def variant(g: Column) -> Column:
        method = g["group"]["print_method"]
        return let(F.concat(slug(product_url), F.lit("|print_method:"), dashed(method)), lambda sku: F.struct(
            keys.variant_key(sku).alias("variant_key"), sku.alias("sku"),
            F.struct(method.alias("label"), nothing.cast("string").alias("option_value_id")).alias("print_method"),
            nothing.alias("napkin_color"), nothing.alias("imprint_color"), nothing.alias("ply_or_size"),
            F.lit(0.0).alias("price_modifier_total"),
            F.transform(g["tiers"], lambda t: F.struct(
                F.coalesce(t["quantity"], F.lit(0)).alias("quantity"),
                F.coalesce(t["unit_price"], F.lit(0.0)).alias("unit_price"),
                F.lit(False).alias("is_sample"), F.lit(False).alias("is_outlier"))).alias("tiers")))

    return F.transform(groups, variant).cast(f"array<{VARIANT}>")


def variants_of(schema_version: Column, variants: Column, pricing: Column, product_url: Column) -> Column:
    """Stored variants from schema version 2 on, else variants built from flat pricing."""
    return F.when(F.coalesce(schema_version, F.lit(1)) >= 2,
                  or_empty(variants, f"array<{VARIANT}>")).otherwise(legacy_variants(pricing, product_url))


def effective_tiers(variant_tiers: Column, base_tiers: Column) -> Column:
    """A variant's own tiers, else the product's."""
    own = or_empty(variant_tiers, f"array<{TIER}>")
    return F.when(F.size(own) > 0, own).otherwise(or_empty(base_tiers, f"array<{TIER}>"))


def widest(variants: Column, base_tiers: Column) -> Column:
    """The tier count a product needs: its widest variant, else its base tiers."""
    own = F.array_max(F.transform(variants, lambda v: F.size(or_empty(v["tiers"], f"array<{TIER}>"))))
    own = F.coalesce(own, F.lit(0))
    return F.when(own > 0, own).otherwise(F.size(or_empty(base_tiers, f"array<{TIER}>")))


def has_pricing(variants: Column, base_tiers: Column) -> Column:
    return (F.exists(variants, lambda v: F.size(or_empty(v["tiers"], f"array<{TIER}>")) > 0)
            | (F.size(or_empty(base_tiers, f"array<{TIER}>")) > 0))


def rendered(tiers: Column, price=price_text, quantity=quantity_text) -> Column:
    """Tiers as cell texts, ``array<struct<q, p>>``. Make it a column of its own
    before ``pivot_cells`` so that rendering happens once, not once per cell."""
    return F.transform(tiers, lambda t: F.struct(
        quantity(t["quantity"]).alias("q"), price(t["unit_price"]).alias("p")))


def pivot_cells(cells: Column, count: int) -> list[Column]:
    """``QtyBreakI`` / ``PriceI`` columns of rendered tiers; past the end they are ''."""
    out = []
    for i in range(max(0, count)):
        out.append(or_blank(F.get(cells, F.lit(i))["q"]).alias(f"QtyBreak{i + 1}"))
        out.append(or_blank(F.get(cells, F.lit(i))["p"]).alias(f"Price{i + 1}"))
    return out


def flat_pricing(variants: Column) -> Column:
    """Variants back to ``(print_method, quantity, unit_price)``, first row per
    method and quantity, without samples and single pieces."""
    listed = F.flatten(F.transform(variants, lambda v: F.transform(
        F.filter(v["tiers"], lambda t: ~F.coalesce(t["is_sample"], F.lit(False)) & (t["quantity"] > 1)),
        lambda t: F.struct(
            F.coalesce(blank_to_null(v["print_method"]["label"]), F.lit("Standard")).alias("print_method"),
            t["quantity"].alias("quantity"), t["unit_price"].alias("unit_price")))))
    placed = F.array_sort(F.transform(listed, lambda e, i: F.struct(
        e["print_method"].alias("print_method"), e["quantity"].alias("quantity"), i.alias("place"),
        e["unit_price"].alias("unit_price"))))
    kept = _first_of_runs(placed, lambda a, b: (
        (a["print_method"] == b["print_method"]) & (a["quantity"] == b["quantity"])))
    return F.transform(kept, lambda e: F.struct(
        e["print_method"].alias("print_method"), e["quantity"].alias("quantity"),
        e["unit_price"].alias("unit_price")))


def min_order(variants: Column, base_tiers: Column) -> Column:
    """Smallest non-sample quantity of any variant, else of base tiers above one."""
    own = F.array_min(F.flatten(F.transform(variants, lambda v: F.transform(
        F.filter(v["tiers"], lambda t: ~F.coalesce(t["is_sample"], F.lit(False))), lambda t: t["quantity"]))))
    base = F.array_min(F.transform(F.filter(base_tiers, lambda t: t["quantity"] > 1), lambda t: t["quantity"]))
    return F.coalesce(own, base)


def print_methods(variants: Column) -> Column:
    """Sorted distinct print methods; unlabelled priced variants count as ``Standard``."""
    counted = F.filter(variants, lambda v: v["print_method"].isNotNull() | (F.size(v["tiers"]) > 0))
    return F.array_sort(F.array_distinct(F.transform(
        counted, lambda v: F.coalesce(v["print_method"]["label"], F.lit("Standard")))))
