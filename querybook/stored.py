"""What a run has stored, read back as products: sheet, statistics, blueprint page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from shelfdelta.operators import paging, stats
from shelfdelta.plans import export, tracked
from shelfdelta.session import staging_path
from shelfdelta.sources.tables import Store


def _stored_products(spark, sf) -> DataFrame:
    """All parts as an API catalog's documents, taken in by a run, as the store gives them back.

    Every fourth price is a text with a number, every ninth a text without one.
    """
    part = spark.read.parquet(f"{sf}/part.parquet")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    text = F.when(F.col("p_partkey") % 9 == 0, "ask").when(F.col("p_partkey") % 4 == 0, cents.cast("string"))
    fields = lambda price: F.to_json(F.struct(
        F.concat(F.lit("v"), F.col("p_partkey")).alias("product_id"), (F.col("p_partkey") % 50).alias("blueprint_id"),
        (F.col("p_size") % 7).alias("provider_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), price.alias("price_cents"), (F.col("p_size") % 3 != 0).alias("available")))
    docs = part.select(F.when(text.isNotNull(), fields(text)).otherwise(fields(cents)).alias("doc"))
    store = Store(spark, staging_path(spark, "stored"))
    tracked.run(store, "Printify", docs, "run-1", F.lit("2024-01-01").cast("timestamp_ntz"))
    return store.products("printify")


@query("""
    SELECT 'PRINTIFY' AS source, 'BP' || (p_partkey % 50) AS supplier_sku, 'v' || p_partkey AS variant_sku,
           'BP' || (p_partkey % 50) || '_P' || (p_size % 7) AS parent_sku, coalesce(p_name, '') AS name,
           coalesce(p_brand, '') AS brand, coalesce(p_type, '') AS category,
           CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(round(p_retailprice * 100)::BIGINT / 100 AS VARCHAR) END AS price,
           CASE WHEN p_size % 3 <> 0 THEN 'Yes' ELSE 'No' END AS active,
           (CASE WHEN p_partkey % 9 = 0 THEN 10 ELSE 11 END)::INT AS n_filled
    FROM part""")
def stored_catalog_sheet(spark, sf) -> DataFrame:
    """The fixed sheet of a stored catalog; ``n_filled`` counts the filled cells of the whole row."""
    sheet = export.fixed_sheet(_stored_products(spark, sf), "printify")
    filled = F.size(F.filter(F.array(*[F.col(f"`{c}`") for c in sheet.columns]), lambda c: c != ""))
    cells = {"source": "Source", "supplier_sku": "Supplier SKU", "variant_sku": "Variant SKU", "parent_sku": "Parent SKU",
             "name": "Product Name", "brand": "Brand", "category": "Category-1", "price": "Price1", "active": "Active"}
    return sheet.select(*[F.col(f"`{h}`").alias(n) for n, h in cells.items()], filled.alias("n_filled"))


@query("""
    SELECT count(*) AS total_products, count(*) FILTER (WHERE p_size % 3 <> 0) AS available_products,
           count(DISTINCT p_partkey % 50) AS unique_blueprints, count(DISTINCT p_size % 7) AS unique_providers
    FROM part""")
def stored_catalog_stats(spark, sf) -> DataFrame:
    return stats.catalog_stats(_stored_products(spark, sf), "printify").drop("last_scraped_at")


@query("""
    SELECT p_partkey % 50 AS blueprint_id, 'v' || p_partkey AS product_id, p_name AS title
    FROM part WHERE p_size % 3 <> 0 ORDER BY 1, 2 LIMIT 20 OFFSET 20""")
def stored_blueprint_page(spark, sf) -> DataFrame:
    """The second page of the available products by blueprint."""
    return paging.blueprint_page(_stored_products(spark, sf), number=2, available=True).select("blueprint_id", "product_id", "title")


# Documents of the dynamic source: variants with tiers of their own, variants that fall back to
# the base tiers, base tiers alone, first-version documents with flat prices. One of each in four parts.
_TIERS = ((25, 1.5, False), (100, 0.75, False), (500, 40.0, True))
_TIER_SQL = ",".join(f'{{"quantity":{q},"unit_price":{p},"is_sample":false,"is_outlier":{str(o).lower()}}}' for q, p, o in _TIERS)
_FIRST_TIER_SQL = _TIER_SQL[:_TIER_SQL.index("}") + 1]


def _dynamic_products(spark, sf) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    tiers = F.array(*[F.struct(F.lit(q).alias("quantity"), F.lit(p).alias("unit_price"), F.lit(False).alias("is_sample"), F.lit(o).alias("is_outlier"))
                      for q, p, o in _TIERS])
    ref = lambda label, value: F.struct(label.alias("label"), F.lit(value).alias("option_value_id"))
    variant = lambda i, label: F.struct(
        F.concat(F.lit("k"), key, F.lit(f"-{i}")).alias("variant_key"), F.concat(F.lit("s"), key, F.lit(f"|{i}")).alias("sku"),
        ref(F.lit(label), str(i)).alias("print_method"), ref(F.col("p_brand"), "9").alias("napkin_color"),
        F.lit(0.25 * i).alias("price_modifier_total"), F.when(kind == 0, tiers).otherwise(F.slice(tiers, 1, 0)).alias("tiers"))
    colour = lambda label, group: F.struct(
        label.alias("label"), F.lit("1").alias("option_value_id"), F.lit(group).alias("group"), F.lit("#fff").alias("hex"), F.lit("c").alias("pms"))
    docs = part.select(F.to_json(F.struct(
        F.concat(F.lit("https://shop/"), key).alias("product_url"), F.when(kind == 3, 1).otherwise(2).alias("schema_version"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("product_sku"), F.col("p_type").alias("category"), F.col("p_size").alias("min_order_qty"),
        F.array(colour(F.col("p_brand"), "napkin"), colour(F.col("p_type"), "imprint")).alias("colors"),
        F.create_map(F.lit("imprint"), F.array(ref(F.lit("ink"), "5"))).alias("options"),
        F.when(kind == 1, F.slice(tiers, 1, 1)).when(kind == 2, tiers).alias("base_tiers"),
        F.when(kind < 2, F.array(variant(1, "Flat"), variant(2, "Foil"))).alias("variants"),
        F.when(kind == 3, F.array(F.struct(F.lit("Foil").alias("print_method"), F.lit(50).alias("quantity"), F.lit(2.5).alias("unit_price")))).alias("pricing"),
        F.array(F.lit("https://img/a.png")).alias("gallery_images"), F.lit("sitemap").alias("discovery_source"))).alias("doc"))
    store = Store(spark, staging_path(spark, "stored"))
    tracked.run(store, "CustomNapkinsNow", docs, "run-1", F.lit("2024-01-01").cast("timestamp_ntz"))
    return store.products("customnapkinsnow")


def _tier_cells_sql() -> str:
    cells = []
    for i, (q, p, _) in enumerate(_TIERS, 1):
        price = f"{p:g}"
        wide = f"kind IN (0, 2)" if i > 1 else "kind < 3"
        flat = ("WHEN kind = 3 THEN '50' ", "WHEN kind = 3 THEN '2.5' ") if i == 1 else ("", "")
        cells += [f"""CASE WHEN {wide} THEN '{q}' {flat[0]}ELSE '' END AS "QtyBreak{i}\"""", f"""CASE WHEN {wide} THEN '{price}' {flat[1]}ELSE '' END AS "Price{i}\""""]
    return ", ".join(cells)


@query(f"""WITH d AS (SELECT *, p_partkey % 4 AS kind, 'https://shop/' || p_partkey AS url FROM part),
v AS (SELECT *, unnest(CASE WHEN kind < 2 THEN [1, 2] ELSE [0] END) AS i FROM d),
x AS (SELECT *, CASE WHEN i = 1 THEN 'Flat' WHEN i = 2 OR kind = 3 THEN 'Foil' ELSE '' END AS pm,
 CASE WHEN i > 0 THEN 's' || p_partkey || '|' || i WHEN kind = 3 THEN p_partkey || '|print_method:Foil' ELSE '' END AS sku,
 to_json(p_brand)::VARCHAR AS brand, to_json(p_type)::VARCHAR AS type FROM v),
y AS (SELECT *, CASE WHEN i > 0 THEN 'k' || p_partkey || '-' || i WHEN kind = 3 THEN left(sha1(sku), 16) ELSE '' END AS key FROM x)
SELECT 'CUSTOMNAPKINSNOW' AS "Source", p_brand AS "Supplier SKU", '' AS "Database Tag", url AS "Product URL", p_name AS "Product Name",
 '' AS "Product Subtype", p_type AS "Category-1", '' AS "Sub-Category-1-1", '' AS "Material", '' AS "Size", '' AS "Description",
 '' AS "Meta Description", '' AS "Print methods", '' AS "Option Groups Detected", '2' AS "Colors Total", p_brand AS "Napkin Colors",
 p_type AS "Imprint Colors", '' AS "Main Image", 'https://img/a.png' AS "Gallery Images", 'true' AS "Has Pricing",
 CAST(p_size AS VARCHAR) AS "Minimum Order Qty", key AS "Variant Key", sku AS "Variant SKU", pm AS "Print Method",
 CASE WHEN i > 0 THEN CAST(i AS VARCHAR) ELSE '' END AS "Print Method Option ID", CASE WHEN i > 0 THEN p_brand ELSE '' END AS "Napkin Color",
 CASE WHEN i > 0 THEN '9' ELSE '' END AS "Napkin Color Option ID", '' AS "Imprint Color", '' AS "Imprint Color Option ID", '' AS "Ply or Size",
 CASE WHEN i = 1 THEN '0.25' WHEN i = 2 THEN '0.5' WHEN kind = 3 THEN '0' ELSE '' END AS "Price Modifier Total",
 CASE WHEN kind = 0 THEN '3' ELSE '' END AS "Tier Outliers", '' AS "Sample Tiers", {_tier_cells_sql()},
 CASE WHEN kind = 2 THEN '{{}}' ELSE '{{"variant_key":"' || key || '","sku":"' || sku || '","print_method":{{"label":"' || pm || '","option_value_id":'
  || CASE WHEN i > 0 THEN '"' || i || '"' ELSE 'null' END || '}},"napkin_color":'
  || CASE WHEN i > 0 THEN '{{"label":' || brand || ',"option_value_id":"9"}}' ELSE 'null' END
  || ',"imprint_color":null,"ply_or_size":null,"price_modifier_total":' || CASE WHEN i = 1 THEN '0.25' WHEN i = 2 THEN '0.5' ELSE '0.0' END
  || ',"tiers":[' || CASE WHEN kind = 0 THEN '{_TIER_SQL}' WHEN kind = 3 THEN '{{"quantity":50,"unit_price":2.5,"is_sample":false,"is_outlier":false}}' ELSE '' END
  || ']}}' END AS "Variant JSON",
 '{{"colors":[{{"label":' || brand || ',"swatch_image_url":null,"option_value_id":"1","option_id":null,"group":"napkin","price_modifier":null}},{{"label":' || type
  || ',"swatch_image_url":null,"option_value_id":"1","option_id":null,"group":"imprint","price_modifier":null}}],"options":{{"imprint":[{{"label":"ink","option_value_id":"5"}}]}},"base_tiers":['
  || CASE kind WHEN 1 THEN '{_FIRST_TIER_SQL}' WHEN 2 THEN '{_TIER_SQL}' ELSE '' END || '],"gallery_images":["https://img/a.png"],"schema_version":'
  || CASE WHEN kind = 3 THEN '1' ELSE '2' END || ',"discovery_source":"sitemap","lastmod":null}}' AS "Product JSON"
FROM y""")
def stored_dynamic_sheet(spark, sf) -> DataFrame:
    """The dynamic-tier export of a stored catalog, every column, both JSON texts."""
    rows, _ = export.dynamic_sheet(_dynamic_products(spark, sf), "customnapkinsnow")
    return rows
