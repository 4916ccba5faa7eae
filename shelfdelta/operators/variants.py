"""Variant matrix of a product's option axes, and the row-per-variant projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from shelfdelta.functions import fixed, keys
from shelfdelta.functions.binding import let
from shelfdelta.functions.text import blank_to_null, cell, dashed, join_list, or_blank, price_text
from shelfdelta.operators import tiers as tr
from shelfdelta.schemas import AXIS, COLOUR, OPTION, TIER, VARIANT

_COMBO = (f"struct<print_method:{AXIS},napkin:{AXIS},imprint:{AXIS},ply_or_size:{AXIS},sku:string,"
          "total:double,axes:int>")


def combination_count(options: Column) -> Column:
    """How many combinations the axes present have, whatever a cap leaves of them."""
    sizes = [F.size(tr.or_empty(F.try_element_at(options, F.lit(a)), f"array<{OPTION}>")) for a in fixed.VARIANT_AXES]
    out = F.lit(1).cast("bigint")
    for size in sizes:
        out = out * F.greatest(size, F.lit(1))
    return out


def axis_combinations(options: Column, head: Column, cap: int | None = None) -> Column:
    """The product of the axes present, in axis order, whole or held at ``cap``.

    ``options`` is ``map<group, array<option>>``. As soon as the list reaches a
    cap, the remaining axes are left out; ``combination_count`` tells how many
    there are. Prefixes that cannot contribute to the first ``cap`` rows are cut
    before they are multiplied. Each entry carries the SKU text that starts with
    ``head`` and the sum of the price modifiers.
    """
    none = F.lit(None).cast(AXIS)

    def picks(axis: str) -> Column:
        return F.transform(tr.or_empty(F.try_element_at(options, F.lit(axis)), f"array<{OPTION}>"), lambda o: F.struct(
            F.struct(o["label"].alias("label"), o["option_value_id"].alias("option_value_id")).alias("ref"),
            F.concat(F.lit(f"|{axis}:"), dashed(o["label"])).alias("part"),
            F.coalesce(o["price_modifier"], F.lit(0.0)).alias("modifier")))

    def joined(axis: str, c: Column, p: Column) -> Column:
        return F.struct(*[(p["ref"] if a == axis else c[a]).alias(a) for a in fixed.VARIANT_AXES],
                        F.concat(c["sku"], p["part"]).alias("sku"), (c["total"] + p["modifier"]).alias("total"),
                        (c["axes"] + 1).alias("axes"))

    def widen(axis: str, combos: Column) -> Column:
        def multiply(b: Column) -> Column:
            prefixes = b["c"] if cap is None else F.slice(b["c"], F.lit(1), F.ceil(F.lit(cap) / F.size(b["p"])).cast("int"))
            product = F.flatten(F.transform(prefixes, lambda c: F.transform(b["p"], lambda p: joined(axis, c, p))))
            if cap is None:
                return F.when(F.size(b["p"]) == 0, b["c"]).otherwise(product.cast(f"array<{_COMBO}>"))
            full = (F.size(b["p"]) == 0) | (F.size(b["c"]) >= cap)
            return F.when(full, b["c"]).otherwise(F.slice(product, 1, cap).cast(f"array<{_COMBO}>"))
        return let(F.struct(combos.alias("c"), picks(axis).alias("p")), multiply)

    combos = F.array(F.struct(*[none.alias(a) for a in fixed.VARIANT_AXES], dashed(head).alias("sku"),
                              F.lit(0.0).alias("total"), F.lit(0).alias("axes"))).cast(f"array<{_COMBO}>")
    for axis in fixed.VARIANT_AXES:
        combos = widen(axis, combos)
    return combos


def build_variants(options: Column, base_tiers: Column, slug: Column, tag: Column,
                   cap: int | None = None) -> Column:
    """``array<variant>`` for a product, all of them or the first ``cap``; one bare variant where it has tiers but no axes."""
    head = F.coalesce(blank_to_null(slug), blank_to_null(tag), F.lit("product"))

    def build(tiers: Column) -> Column:
        def variant(c: Column) -> Column:
            return F.struct(
                keys.variant_key(c["sku"]).alias("variant_key"), c["sku"].alias("sku"),
                c["print_method"].alias("print_method"), c["napkin"].alias("napkin_color"),
                c["imprint"].alias("imprint_color"), c["ply_or_size"].alias("ply_or_size"),
                F.round(c["total"], 2).alias("price_modifier_total"), tiers.alias("tiers"))

        # Without axes only a priced product has a variant.
        kept = F.filter(axis_combinations(options, head, cap), lambda c: (c["axes"] > 0) | (F.size(tiers) > 0))
        return F.transform(kept, variant).cast(f"array<{VARIANT}>")

    return let(tr.or_empty(base_tiers, f"array<{TIER}>"), build)


def colours_of(options: Column) -> Column:
    """Napkin and imprint options as one colour list."""
    def part(group: str) -> Column:
        return F.transform(tr.or_empty(F.try_element_at(options, F.lit(group)), f"array<{OPTION}>"),
                           lambda o: F.struct(
            o["label"].alias("label"), o["swatch_image_url"].alias("swatch_image_url"),
            o["option_value_id"].alias("option_value_id"), o["option_id"].alias("option_id"),
            F.lit(group).alias("group"), o["price_modifier"].alias("price_modifier")))
    return F.concat(part("napkin"), part("imprint")).cast(f"array<{COLOUR}>")


def stored_colours(df: DataFrame) -> Column:
    """The ``colors`` list with exactly the fields exports show; an empty list where the table has none."""
    kind = {f.name: f.dataType for f in df.schema.fields}.get("colors")
    if kind is None:
        return F.array().cast(f"array<{COLOUR}>")
    have, shape = kind.elementType.names, StructType.fromDDL(COLOUR.removeprefix("struct<").removesuffix(">"))
    pick = lambda c, x: (c[x.name] if x.name in have else F.lit(None)).cast(x.dataType)
    return tr.or_empty(F.transform("colors", lambda c: F.named_struct(*[e for x in shape for e in (F.lit(x.name), pick(c, x))])), f"array<{COLOUR}>")


def colour_labels(colours: Column, group: str) -> Column:
    return F.transform(F.filter(colours, lambda c: c["group"] == group), lambda c: c["label"])


class _Fields:
    """Optional document fields: a column the table lacks reads as null."""

    def __init__(self, df: DataFrame):
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def __call__(self, name: str, dtype: str = "string") -> Column:
        return F.col(name) if name in self._types else F.lit(None).cast(dtype)

    def text(self, name: str) -> Column:
        return cell(F.col(name), self._types[name]) if name in self._types else F.lit("")


def with_variants(products: DataFrame) -> DataFrame:
    """Add ``_variants``: stored ones, or built from flat pricing for old documents."""
    f = _Fields(products)
    return products.withColumn("_variants", tr.variants_of(
        f("schema_version", "int"), f("variants", f"array<{VARIANT}>"), tr.pricing_of(products),
        f("product_url")))


def export_size(products: DataFrame) -> DataFrame:
    """One row: widest tier list, rows an export would have, products; plus the two
    warnings an operator needs (nothing matched, no tiers anywhere)."""
    rows = with_variants(products)
    f = _Fields(products)
    base = f("base_tiers", f"array<{TIER}>")
    return rows.select(
        tr.widest(F.col("_variants"), base).alias("w"),
        F.greatest(F.size("_variants"), F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("w"), F.lit(0)).alias("max_tiers"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_variants"),
        F.count("*").alias("products")).select(
        "*", (F.col("products") == 0).alias("empty_match"),
        ((F.col("products") > 0) & (F.col("max_tiers") == 0)).alias("no_tiers"))


def product_cells(f: _Fields, colours: Column, priced: Column) -> dict[str, Column]:
    return {
        "Source": F.upper(f("source")),
        "Supplier SKU": f.text("product_sku"), "Database Tag": f.text("database_tag"),
        "Product URL": f.text("product_url"), "Product Name": f.text("name"),
        "Product Subtype": f.text("product_subtype"), "Category-1": f.text("category"),
        "Sub-Category-1-1": f.text("subcategory"), "Material": f.text("material"),
        "Size": f.text("size"), "Description": f.text("description"),
        "Meta Description": f.text("meta_description"), "Print methods": f.text("print_methods"),
        "Option Groups Detected": f.text("option_groups_detected"),
        "Colors Total": F.size(colours).cast("string"),
        "Napkin Colors": join_list(colour_labels(colours, "napkin")),
        "Imprint Colors": join_list(colour_labels(colours, "imprint")),
        "Main Image": f.text("main_image"), "Gallery Images": f.text("gallery_images"),
        "Has Pricing": F.when(priced, "true").otherwise("false"),
        # Zero reads as absent here, as every falsy value does.
        "Minimum Order Qty": F.nullif(f.text("min_order_qty"), F.lit("0")),
    }


def variant_cells(v: Column) -> dict[str, Column]:
    tiers = tr.or_empty(v["tiers"], f"array<{TIER}>")
    text = lambda c: or_blank(c)
    return {
        "Variant Key": text(v["variant_key"]), "Variant SKU": text(v["sku"]),
        "Print Method": text(v["print_method"]["label"]),
        "Print Method Option ID": text(v["print_method"]["option_value_id"]),
        "Napkin Color": text(v["napkin_color"]["label"]),
        "Napkin Color Option ID": text(v["napkin_color"]["option_value_id"]),
        "Imprint Color": text(v["imprint_color"]["label"]),
        "Imprint Color Option ID": text(v["imprint_color"]["option_value_id"]),
        "Ply or Size": text(v["ply_or_size"]["label"]),
        "Price Modifier Total": F.when(
            v.isNotNull(), price_text(F.coalesce(v["price_modifier_total"], F.lit(0.0)))).otherwise(""),
        "Tier Outliers": tr.ordinals(tiers, "is_outlier"),
        "Sample Tiers": tr.ordinals(tiers, "is_sample"),
    }


def expand_variants(products: DataFrame, max_tiers: int, keep: list[str] | None = None, only: int | None = None) -> DataFrame:
    """One row per variant (one bare row for products without any), ``max_tiers``
    tier pairs, and two JSON columns that hold the full structure.

    A pure row expansion: the scan is exploded in place, nothing is shuffled.
    ``keep`` names input columns to carry along in front. ``only`` previews one row of each
    product: the row numbered so, from 0, or its last.
    """
    f = _Fields(products)
    base = f("base_tiers", f"array<{TIER}>")
    colours = stored_colours(products)
    options = f("options", "map<string,array<struct<label:string,option_value_id:string>>>")
    no_options = F.create_map().cast("map<string,array<struct<label:string,option_value_id:string>>>")
    parts = {
        "colors": colours, "options": F.coalesce(options, no_options), "base_tiers": tr.or_empty(base, f"array<{TIER}>"),
        "gallery_images": tr.or_empty(f("gallery_images", "array<string>"), "array<string>"),
        "schema_version": f("schema_version", "int"), "discovery_source": f("discovery_source"), "lastmod": f("lastmod")}
    # Names are given outright: aliases of lists that are still unresolved get lost here.
    blob = F.to_json(F.named_struct(*[e for n, c in parts.items() for e in (F.lit(n), c)]), {"ignoreNullFields": "false"})
    rows = with_variants(products)
    cells = product_cells(f, colours, tr.has_pricing(F.col("_variants"), base))
    shown = F.col("_variants")
    if only is not None:
        shown = F.slice(shown, F.greatest(F.least(F.lit(only + 1), F.size(shown)), F.lit(1)), F.lit(1))
    wide = rows.select(*(keep or []), base.alias("_base"), blob.alias("Product JSON"),
                       *[or_blank(c).alias(n) for n, c in cells.items()],
                       F.posexplode_outer(shown).alias("_ordinal", "_v"))
    v = F.col("_v")
    # The effective tier list is a column of its own so that it is computed once
    # per row, not once per cell.
    shaped = wide.select(*[c for c in wide.columns if c != "_base"],
                         tr.rendered(tr.effective_tiers(v["tiers"], F.col("_base"))).alias("_tiers"))
    return shaped.select(
        *(keep or []), F.col("_ordinal").alias("variant_ordinal"),
        *[F.col(f"`{c}`") for c in fixed.PRODUCT_COLUMNS],
        *[c.alias(n) for n, c in variant_cells(v).items()],
        *tr.pivot_cells(F.col("_tiers"), max_tiers),
        F.coalesce(F.to_json(v, {"ignoreNullFields": "false"}), F.lit("{}")).alias("Variant JSON"),
        F.col("Product JSON"))
