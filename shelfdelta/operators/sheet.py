"""The fixed product sheet: per-source column maps and row expansion.

A source's map goes from sheet header to a column builder over the product row.
New sources register theirs; a source without one uses the generic map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfdelta.functions import fixed
from shelfdelta.functions import text as X
from shelfdelta.operators import tiers as tr

Builder = Callable[["Row"], Column]
_MAPS: dict[str, dict[str, Builder]] = {}
_GROUPS: dict[str, str] = {}
GENERIC = "default"


class Row:
    """Column access for builders: absent columns read as null or ''."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def has(self, name: str) -> bool:
        return name in self.types

    def col(self, name: str, dtype: str = "string") -> Column:
        return F.col(name) if self.has(name) else F.lit(None).cast(dtype)

    def text(self, name: str) -> Column:
        return X.cell(F.col(name), self.types[name]) if self.has(name) else F.lit("")

    def joined(self, name: str, sep: str = "|", limit: int | None = None) -> Column:
        if not (self.has(name) and isinstance(self.types[name], T.ArrayType)):
            return self.text(name)
        items = F.slice(F.col(name), 1, limit) if limit else F.col(name)
        return X.or_blank(F.array_join(items, sep))

    def member(self, name: str, field: str) -> Column:
        """One field of every struct in a list, empty ones left out."""
        kind = self.types.get(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if field in kind.elementType.names:
                return X.join_list(F.transform(F.col(name), lambda e: e[field]))
            return F.lit("")
        if isinstance(kind, T.ArrayType) and field == "hex":
            return X.join_list(F.col(name))
        return F.lit("")

    def tier(self, index: int, field: str) -> Column:
        kind = self.types.get("pricing")
        if not isinstance(kind, T.ArrayType) or field not in kind.elementType.names:
            return F.lit("")
        return X.cell(F.get(F.col("pricing"), F.lit(index))[field], kind.elementType[field].dataType)

    def dollars(self, amount: str, cents: str) -> Column:
        return F.coalesce(X.float_text(F.round(self.col(amount, "double").try_cast("double"), 2)),
                          X.cents_text(self.col(cents, "bigint")))


def field(*names: str) -> Builder:
    """The first of the fields with a value."""
    return lambda r: X.or_blank(X.first_filled(*[r.text(n) for n in names]))


def constant(value: str) -> Builder:
    return lambda r: F.lit(value)


def listed(name: str, sep: str = "|") -> Builder:
    return lambda r: r.joined(name, sep)


def register_source(source: str, columns: dict[str, Builder], expand: str | None = None) -> None:
    """Add or replace a source's column map. ``expand`` is ``shape_size`` or
    ``print_method`` for sources whose flat pricing becomes several rows."""
    _MAPS[source.lower()] = columns
    if expand:
        _GROUPS[source.lower()] = expand


def registered_sources() -> list[str]:
    return [s for s in _MAPS if s != GENERIC]


_upper_source: Builder = lambda r: F.upper(F.coalesce(r.col("source"), F.lit("unknown")))

# Which field fills which header, source by source.
register_source("sportsgearswag", {
    "Source": _upper_source,
    "Supplier SKU": field("sku"), "Variant SKU": field("sku"), "Product Name": field("name"),
    "Category-1": field("category"), "Product Type": field("product_type"),
    "Hex Color": lambda r: r.member("colors", "hex"),
    "PMS Color Match": lambda r: r.member("colors", "pms"),
    "Size": listed("sizes", ", "), "Minimum Order Qty": field("min_order_qty"),
    "Optional Main Image": field("main_image"), "Gallery Images": field("product_url"),
    "Active": constant("Yes"),
    **{f"QtyBreak{i + 1}": (lambda r, i=i: r.tier(i, "qty_from")) for i in range(10)},
    **{f"Price{i + 1}": (lambda r, i=i: r.tier(i, "price")) for i in range(10)},
})
register_source("printify", {
    "Source": _upper_source,
    "Supplier SKU": lambda r: F.concat(F.lit("BP"), r.text("blueprint_id")),
    "Variant SKU": field("product_id"),
    "Parent SKU": lambda r: F.concat(F.lit("BP"), r.text("blueprint_id"), F.lit("_P"), r.text("provider_id")),
    "Product Name": field("title"), "Long Description": field("description"), "Brand": field("brand"),
    "Category-1": field("category"), "Primary Supplier": field("provider_name"),
    "Country of Origin": field("provider_country"), "Hex Color": field("color_hex"),
    "Variant Type": field("color_label"), "Size": field("size_label"),
    "Minimum Order Qty": constant("1"), "QtyBreak1": constant("1"),
    "Price1": lambda r: r.dollars("price_usd", "price_cents"),
    "QtyBreak2": lambda r: F.when(r.col("price_subscription_usd", "double").isNotNull(), "1").otherwise(""),
    "Price2": lambda r: r.dollars("price_subscription_usd", "price_subscription_cents"),
    "All Charges": lambda r: r.dollars("min_shipping_usd", "min_shipping_cents"),
    "Print Position": listed("print_positions"),
    "Optional Main Image": lambda r: X.or_blank(X.main_image(r.col("images", "array<string>"))),
    "Gallery Images": lambda r: r.joined("images", "|"),
    "Active": lambda r: X.yes_no(r.col("available", "boolean")),
})
register_source("commonsku", {
    "Source": _upper_source,
    "Primary Supplier": field("name"), "Product Name": field("name"),
    "Long Description": field("description"), "Gallery Images": field("url"), "Active": constant("Yes"),
})
_PAGE_SOURCE = {
    "Source": _upper_source,
    "Supplier SKU": field("product_url"), "Product Name": field("name"),
    "Long Description": field("description"), "Category-1": field("category"),
    "Sub-Category-1-1": field("subcategory"), "Material": field("material"),
    "Minimum Order Qty": field("min_order_qty"), "Optional Main Image": field("main_image"),
    "Gallery Images": listed("gallery_images"), "Active": constant("Yes"),
}
register_source("customcoasters", {**_PAGE_SOURCE, "Print methods": listed("imprint_styles")}, "shape_size")
register_source("customnapkinsnow", {**_PAGE_SOURCE, "Size": field("size"),
                                     "Print methods": listed("print_methods")}, "print_method")
register_source("exposure", {
    "Source": _upper_source,
    "Supplier SKU": field("product_id"), "Product Name": field("name"),
    "Long Description": field("description"), "Category-1": field("category"), "Brand": field("brand"),
    "Optional Main Image": field("image_url"), "Active": constant("Yes"),
})
register_source("yardsignplus", {
    "Source": _upper_source,
    "Supplier SKU": field("product_id"), "Product Name": field("name"),
    "Long Description": field("description"), "Category-1": field("category"), "Size": field("size"),
    "Material": field("material"), "Optional Main Image": field("image_url"), "Active": constant("Yes"),
})
register_source(GENERIC, {
    "Source": _upper_source,
    "Supplier SKU": field("sku", "product_id", "id"), "Variant SKU": field("variant_sku", "sku"),
    "Product Name": field("name", "title"), "Long Description": field("description", "long_description"),
    "Category-1": field("category"), "Hex Color": lambda r: r.member("colors", "hex"),
    "Size": lambda r: X.or_blank(X.first_filled(r.joined("sizes", ", "), r.text("size"))),
    "Material": field("material"), "Optional Main Image": field("main_image", "image_url", "image"),
    "Gallery Images": field("product_url", "url"), "Active": constant("Yes"),
})

_GROUP = ("array<struct<kind:string,size:string,min_quantity:bigint,"
          "tiers:array<struct<q:string,p:string>>>>")


def _rows_of(groups: Column) -> Column:
    """A row for every ``FIXED_TIERS`` tiers of a group, at least one."""
    step = fixed.FIXED_TIERS
    return F.flatten(F.transform(groups, lambda g: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(g["tiers"]) - 1) / step), F.lit(0)).cast("int")),
        lambda k: g.withField("tiers", F.slice(g["tiers"], k * step + 1, step)))))


def _row_groups(df: DataFrame, expand: str, tier_limit: int | None) -> Column:
    pricing = tr.pricing_of(df)
    shown = lambda ts: tr.rendered(ts, lambda c: X.or_blank(X.float_text(c)),
                                   lambda c: X.or_blank(c.cast("string")))
    if expand == "shape_size":
        groups = F.transform(tr.shape_size_groups(pricing, tier_limit), lambda g: F.struct(
            g["group"]["shape"].alias("kind"), g["group"]["size"].alias("size"),
            g["min_quantity"].alias("min_quantity"), shown(g["tiers"]).alias("tiers")))
        kind, size = "Default", ""
    else:
        groups = F.transform(tr.method_groups(pricing, tier_limit), lambda g: F.struct(
            g["group"]["print_method"].alias("kind"), F.lit(None).cast("string").alias("size"),
            g["min_quantity"].alias("min_quantity"), shown(g["tiers"]).alias("tiers")))
        kind, size = "Standard", None
    bare = F.array(F.struct(
        F.lit(kind).alias("kind"), F.lit(size).cast("string").alias("size"),
        F.lit(None).cast("bigint").alias("min_quantity"),
        F.array().cast("array<struct<q:string,p:string>>").alias("tiers")))
    return F.when(F.size(groups) > 0, _rows_of(groups.cast(_GROUP))).otherwise(bare.cast(_GROUP))


def _by_source(sources: list[str], source: Column, pick: Callable[[str], Column], default: Column) -> Column:
    out = F
    for name in sources:
        out = out.when(source == name, pick(name))
    return out.otherwise(default) if sources else default


def to_sheet(products: DataFrame, expanded: bool = True, sources: list[str] | None = None,
             house_label: str = "Catalog SKU", keep: list[str] | None = None, tier_limit: int | None = None) -> DataFrame:
    """Products as rows of the fixed sheet.

    A group with more tiers than the sheet has columns goes on in further rows with the
    same Variant SKU, unless ``tier_limit`` holds it at so many.

    One pass: each header is a CASE over the sources it has a builder for, so a
    mixed table is scanned once, not once per source. Naming ``sources`` narrows
    the CASE at plan time. Text conversions use ``try_`` forms; a value that cannot
    be rendered gives an empty cell and never fails the row.
    """
    row = Row(products)
    wanted = [s.lower() for s in sources] if sources else registered_sources()
    names = [s for s in wanted if s in _MAPS and s != GENERIC]
    source = F.lower(F.coalesce(row.col("source"), F.lit("unknown")))
    carried = [F.col(k) for k in keep or []]

    grouping = [s for s in names if s in _GROUPS] if expanded else []
    base: dict[str, Column] = {}
    for header in fixed.sheet_columns(house_label):
        # Only sources that differ from the generic rule or fill this header appear.
        filled = [s for s in names if header in _MAPS[s]]
        generic = _MAPS[GENERIC].get(header)
        others = [s for s in names if s not in filled] if generic else []
        pick = {**{s: _MAPS[s][header](row) for s in filled}, **{s: F.lit("") for s in others}}
        base[header] = X.or_blank(_by_source(list(pick), source, pick.__getitem__,
                                             generic(row) if generic else F.lit("")))
    if not grouping:
        return products.select(*carried, *[c.alias(h) for h, c in base.items()])

    none = F.array(F.lit(None).cast(_GROUP[6:-1])).cast(_GROUP)
    groups = _by_source(grouping, source, lambda s: _row_groups(products, _GROUPS[s], tier_limit), none)
    wide = products.select(*carried, source.alias("_source"), row.col("product_url").alias("_url"),
                           *[c.alias(h) for h, c in base.items()], F.explode(groups).alias("_g"))
    g = F.col("_g")
    url = X.or_blank(F.col("_url"))
    shape_rows = F.col("_source").isin([s for s in grouping if _GROUPS[s] == "shape_size"])
    tail = F.when(shape_rows, F.concat(X.shape_part(g["kind"]), F.lit("|"), X.size_part(X.or_blank(g["size"])))
                  ).otherwise(X.dashed(g["kind"]))
    override = {
        "Variant SKU": F.when(url != "", F.concat(url, F.lit("|"), tail)).otherwise(tail),
        "Variant Type": g["kind"],
        "Minimum Order Qty": X.or_blank(g["min_quantity"].cast("string")),
    }
    for i in range(fixed.FIXED_TIERS):
        tier = F.get(g["tiers"], F.lit(i))
        override[f"QtyBreak{i + 1}"] = X.or_blank(tier["q"])
        override[f"Price{i + 1}"] = X.or_blank(tier["p"])
    out = []
    for h in fixed.sheet_columns(house_label):
        kept = F.col(f"`{h}`")
        if h == "Size":
            kept = F.when(g.isNotNull() & shape_rows, X.or_blank(g["size"])).otherwise(kept)
        elif h in override:
            kept = F.when(g.isNotNull(), override[h]).otherwise(kept)
        out.append(kept.alias(h))
    return wide.select(*carried, *out)


def preview(sheet: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first rows of a sheet as maps without their empty cells."""
    cells = F.create_map(*[x for c in sheet.columns if not c.startswith("_")
                           for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return sheet.orderBy(*order).limit(limit).select(
        F.map_filter(cells, lambda k, v: v.isNotNull() & (v != "")).alias("row"))
