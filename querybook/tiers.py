"""Tier, variant and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from querybook.derived import (METHOD_SQL, PRICE_SQL, SLUG_SQL, URL_SQL, price_rows, priced_parts, spread, table)
from shelfdelta.functions import fixed, keys, text as X, urls as U
from shelfdelta.operators import combinations as C, sheet as S, tiers as tr, variants as V
from shelfdelta.plans import export
from shelfdelta.schemas import TIER, VARIANT
from shelfdelta.session import staging_path
from shelfdelta.sources import csv_files

_PRICE_TEXT = """CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR)
 ELSE CAST(CAST(cents / 100.0 AS DOUBLE) AS VARCHAR) END"""
_FLOAT_TEXT = "CAST(CAST(cents / 100.0 AS DOUBLE) AS VARCHAR)"

# One tier per print method and quantity: of the two shapes' prices the first listed.
_METHOD_TIERS = f"""method_tiers AS (
  SELECT l_partkey, coalesce(nullif({METHOD_SQL}, ''), 'Standard') AS print_method, quantity, cents,
         row_number() OVER (PARTITION BY l_partkey, method ORDER BY quantity, shape) AS place
  FROM price_rows)"""


@query(f"""WITH {PRICE_SQL}, {_METHOD_TIERS}
SELECT p_partkey, print_method, CAST(place AS BIGINT) AS place, quantity, cents / 100.0 AS unit_price
FROM part JOIN method_tiers ON p_partkey = l_partkey WHERE place <= 16""")
def tier_rows(spark, sf) -> DataFrame:
    groups = priced_parts(spark, sf).select("p_partkey", F.explode(tr.method_groups(F.col("pricing"), fixed.FIXED_TIERS)).alias("g"))
    tiers = groups.select("p_partkey", F.col("g.group.print_method").alias("print_method"),
                          F.posexplode("g.tiers").alias("i", "t"))
    return tiers.select("p_partkey", "print_method", (F.col("i") + 1).cast("bigint").alias("place"),
                        F.col("t.quantity").alias("quantity"), F.col("t.unit_price").alias("unit_price"))


_SHAPE_TIERS = """shape_tiers AS (
  SELECT l_partkey, shape, quantity, cents, row_number() OVER (
    PARTITION BY l_partkey, shape ORDER BY quantity, method) AS place FROM price_rows)"""


@query(f"""WITH {PRICE_SQL}, {_SHAPE_TIERS}
SELECT p_partkey, shape, CAST(min(quantity) AS VARCHAR) AS min_qty,
 {", ".join(f'''coalesce(max(CASE WHEN place = {i} THEN CAST(quantity AS VARCHAR) END), '') AS "QtyBreak{i}",
 coalesce(max(CASE WHEN place = {i} THEN {_FLOAT_TEXT} END), '') AS "Price{i}"''' for i in range(1, 17))}
FROM part JOIN shape_tiers ON p_partkey = l_partkey GROUP BY p_partkey, shape""")
def tier_pivot_16(spark, sf) -> DataFrame:
    groups = priced_parts(spark, sf).select("p_partkey", F.explode(tr.shape_size_groups(F.col("pricing"), fixed.FIXED_TIERS)).alias("g"))
    cells = groups.select("p_partkey", F.col("g.group.shape").alias("shape"),
                          F.col("g.min_quantity").cast("string").alias("min_qty"),
                          tr.rendered(F.col("g.tiers"), lambda c: X.or_blank(X.float_text(c))).alias("cells"))
    return cells.select("p_partkey", "shape", "min_qty", *tr.pivot_cells(F.col("cells"), fixed.FIXED_TIERS))


# The widest list is data-dependent; a part has at most 6 x 50 price points. SQL has
# no data-dependent width, so both sides report the pivot as (column, value) rows.
_ALL_TIERS = """all_tiers AS (
  SELECT l_partkey, quantity, min(cents) AS cents FROM price_rows GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY quantity) AS place FROM all_tiers)"""


def _base_tiers(spark, sf) -> DataFrame:
    """Parts with one tier per quantity as ``base_tiers``, flagged."""
    best = price_rows(spark, sf).groupBy("l_partkey", "quantity").agg(F.min("cents").alias("cents"))
    lists = best.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("quantity", "cents"))).alias("raw"))
    return lists.select("l_partkey", tr.flagged(F.transform("raw", lambda e: F.struct(
        e["quantity"].alias("quantity"), (e["cents"] / 100.0).alias("unit_price")))).alias("base_tiers"))


@query(f"""WITH {PRICE_SQL}, {_ALL_TIERS}
SELECT l_partkey, 'QtyBreak' || place AS "column", CAST(quantity AS VARCHAR) AS value,
 (SELECT max(place) FROM placed) AS max_tiers FROM placed
UNION ALL SELECT l_partkey, 'Price' || place, {_PRICE_TEXT}, (SELECT max(place) FROM placed) FROM placed""")
def tier_pivot_dynamic(spark, sf) -> DataFrame:
    docs = _base_tiers(spark, sf).withColumn("schema_version", F.lit(2)).withColumn(
        "variants", F.array().cast(f"array<{VARIANT}>"))
    size = V.export_size(docs).first()["max_tiers"]
    shown = docs.select("l_partkey", tr.rendered(tr.effective_tiers(
        F.lit(None).cast(f"array<{TIER}>"), F.col("base_tiers"))).alias("cells"))
    wide = shown.select("l_partkey", *tr.pivot_cells(F.col("cells"), size))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in fixed.tier_columns(size)])
    return wide.select("l_partkey", F.inline(F.filter(cells, lambda c: c["value"] != ""))).withColumn(
        "max_tiers", F.lit(size).cast("bigint"))


@query(f"""WITH {PRICE_SQL}, {_ALL_TIERS},
bulk AS (SELECT l_partkey, count(*) FILTER (quantity >= 25) >= 2 AS multi FROM placed GROUP BY 1),
mid AS (SELECT l_partkey, multi, median(cents / 100.0) FILTER (NOT (quantity = 1 AND multi)) AS med
        FROM placed JOIN bulk USING (l_partkey) GROUP BY 1, 2)
SELECT l_partkey, quantity, cents / 100.0 AS unit_price, quantity = 1 AND multi AS is_sample,
 coalesce(med > 0 AND cents / 100.0 > 10 * med, false) AS is_outlier FROM placed JOIN mid USING (l_partkey)""")
def tier_outlier_flags(spark, sf) -> DataFrame:
    return _base_tiers(spark, sf).select("l_partkey", F.inline("base_tiers"))


@query(f"""WITH {PRICE_SQL}, {_ALL_TIERS},
bulk AS (SELECT l_partkey, count(*) FILTER (quantity >= 25) >= 2 AS multi FROM placed GROUP BY 1),
mid AS (SELECT l_partkey, multi, median(cents / 100.0) FILTER (NOT (quantity = 1 AND multi)) AS med
        FROM placed JOIN bulk USING (l_partkey) GROUP BY 1, 2)
SELECT l_partkey, coalesce(string_agg(CASE WHEN med > 0 AND cents / 100.0 > 10 * med
   THEN CAST(place AS VARCHAR) END, ',' ORDER BY place), '') AS outliers,
 coalesce(string_agg(CASE WHEN quantity = 1 AND multi THEN CAST(place AS VARCHAR) END, ',' ORDER BY place), '')
  AS samples FROM placed JOIN mid USING (l_partkey) GROUP BY l_partkey""")
def tier_ordinals(spark, sf) -> DataFrame:
    return _base_tiers(spark, sf).select("l_partkey", tr.ordinals(F.col("base_tiers"), "is_outlier").alias("outliers"),
                                         tr.ordinals(F.col("base_tiers"), "is_sample").alias("samples"))


@query(f"""WITH {PRICE_SQL}
SELECT p_partkey, coalesce(nullif({METHOD_SQL}, ''), 'Standard') AS print_method, quantity,
 arg_min(cents, shape) / 100.0 AS unit_price, min(min(quantity)) OVER (PARTITION BY p_partkey) AS min_order
FROM part JOIN price_rows ON p_partkey = l_partkey WHERE quantity > 1 GROUP BY p_partkey, method, quantity""")
def legacy_pricing_first_wins(spark, sf) -> DataFrame:
    """Flat pricing rebuilt from synthesised variants: first price per method and quantity."""
    docs = priced_parts(spark, sf).withColumn("_variants", tr.legacy_variants(tr.pricing_of(priced_parts(spark, sf)), F.col("product_url")))
    multi = F.transform("_variants", lambda v: v.withField("tiers", F.filter(v["tiers"], lambda t: t["quantity"] > 1)))
    flat = docs.withColumn("_multi", multi).select(
        "p_partkey", tr.min_order(F.col("_multi"), F.array().cast(
            "array<struct<quantity:bigint,unit_price:double>>")).alias("min_order"),
        F.inline(tr.flat_pricing(F.col("_variants"))))
    return flat.select("p_partkey", "print_method", "quantity", "unit_price", "min_order")


# Option axes of a part: print methods from regions, napkin colours from the nations
# of one region after another, imprint colours from regions, sizes from a constant.
_AXES = """pm AS (SELECT row_number() OVER (ORDER BY r_name) AS i, r_name AS l FROM region),
nc AS (SELECT row_number() OVER (ORDER BY n_name) AS i, n_name AS l FROM nation),
ic AS (SELECT row_number() OVER (ORDER BY r_name DESC) AS i, 'ink ' || r_name AS l FROM region)"""


@query(f"""WITH {_AXES}, first_two AS (
  SELECT pm.l AS p, nc.l AS n, row_number() OVER (ORDER BY pm.i, nc.i) AS k FROM pm, nc),
three AS (SELECT p, n, ic.l AS c, row_number() OVER (ORDER BY k, ic.i) AS k FROM first_two, ic),
capped AS (SELECT * FROM three WHERE k <= 500),
skus AS (SELECT p_partkey, k, p_size, replace(replace({SLUG_SQL} || '|print_method:' || p || '|napkin:' || n
  || '|imprint:' || c, ' ', '-'), '/', '-') AS sku, p, n, c FROM part, capped)
SELECT p_partkey, count(*) AS variants, CAST(max(k) AS BIGINT) AS last_place,
 min(left(sha1(sku), 16)) AS first_key, min(sku) AS first_sku, max(sku) AS last_sku,
 CAST(round(sum(0.25 * (length(n) - 7)), 2) AS DOUBLE) AS modifiers FROM skus GROUP BY p_partkey""")
def variant_matrix_capped(spark, sf) -> DataFrame:
    """5 print methods x 25 colours x 5 inks, cut at 500 in axis order."""
    # Region and nation are the bounded dimension tables (5 and 25 rows).
    regions = table(spark, sf, "region").agg(F.array_sort(F.collect_list("r_name")))
    nations = table(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_name")))
    option = lambda label, extra: F.struct(
        label.alias("label"), F.lit("1").alias("option_value_id"), F.lit("1").alias("option_id"),
        extra.alias("price_modifier"), F.lit(None).cast("string").alias("swatch_image_url"), F.lit("").alias("step_label"))
    zero = F.lit(0.0)
    options = F.create_map(
        F.lit("print_method"), F.transform("r", lambda x: option(x, zero)),
        F.lit("napkin"), F.transform("n", lambda x: option(x, 0.25 * (F.length(x) - 7))),
        F.lit("imprint"), F.transform(F.reverse("r"), lambda x: option(F.concat(F.lit("ink "), x), zero)))
    tier = F.array(F.struct(F.lit(10).cast("bigint").alias("quantity"), F.lit(1.0).alias("unit_price"),
                            F.lit(False).alias("is_sample"), F.lit(False).alias("is_outlier")))
    parts = spread(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", "p_name", regions.scalar().alias("r"), nations.scalar().alias("n")).withColumn("options", options)
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    built = parts.select("p_partkey", V.build_variants(F.col("options"), tier, slug, F.lit(None).cast("string"), fixed.VARIANT_CAP).alias("v"))
    field = lambda f: F.transform("v", lambda x: x[f])
    return built.select(
        "p_partkey", F.size("v").cast("bigint").alias("variants"), F.size("v").cast("bigint").alias("last_place"),
        F.array_min(field("variant_key")).alias("first_key"), F.array_min(field("sku")).alias("first_sku"),
        F.array_max(field("sku")).alias("last_sku"),
        F.round(F.aggregate(field("price_modifier_total"), F.lit(0.0), lambda a, x: a + x), 2).alias("modifiers"))


def _documents(spark, sf) -> DataFrame:
    """Parts as first-version product documents; parts without any price keep a row."""
    colour = lambda label, group: F.struct(
        label.alias("label"), F.lit(None).cast("string").alias("swatch_image_url"),
        F.lit("1").alias("option_value_id"), F.lit("2").alias("option_id"), F.lit(group).alias("group"),
        F.lit(0.0).alias("price_modifier"))
    docs = priced_parts(spark, sf)
    return docs.select(
        "p_partkey", F.lit("customnapkinsnow").alias("source"), "product_url", F.lit(1).alias("schema_version"),
        F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("product_sku"),
        F.col("p_size").cast("bigint").alias("min_order_qty"),
        F.array(colour(F.col("p_brand"), "napkin"), colour(F.col("p_type"), "imprint")).alias("colors"),
        F.array(F.concat(F.lit("https://img/"), F.col("p_partkey").cast("string"), F.lit(".png")),
                F.lit("https://img/b.png")).alias("gallery_images"),
        "pricing")


@query(f"""WITH {PRICE_SQL},
f AS (SELECT l_partkey, coalesce(nullif({METHOD_SQL}, ''), 'Standard') AS pm, quantity, cents,
        row_number() OVER (PARTITION BY l_partkey, method ORDER BY quantity, shape) AS place
      FROM price_rows),
v AS (SELECT l_partkey, pm, count(*) AS n, max(CASE WHEN place = 1 THEN CAST(quantity AS VARCHAR) END) AS q1,
        max(CASE WHEN place = 1 THEN {_PRICE_TEXT} END) AS p1,
        max(CASE WHEN place = 3 THEN CAST(quantity AS VARCHAR) END) AS q3,
        max(CASE WHEN place = 3 THEN {_PRICE_TEXT} END) AS p3 FROM f GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN pm IS NULL THEN '' ELSE {SLUG_SQL} || '|print_method:'
        || replace(replace(pm, ' ', '-'), '/', '-') END AS sku
      FROM part LEFT JOIN v ON p_partkey = l_partkey)
SELECT p_partkey, 'CUSTOMNAPKINSNOW' AS "Source", {URL_SQL} AS "Product URL", p_name AS "Product Name",
 p_brand AS "Supplier SKU", '2' AS "Colors Total", p_brand AS "Napkin Colors", p_type AS "Imprint Colors",
 'https://img/' || p_partkey || '.png|https://img/b.png' AS "Gallery Images",
 CASE WHEN pm IS NULL THEN 'false' ELSE 'true' END AS "Has Pricing", CAST(p_size AS VARCHAR) AS "Minimum Order Qty",
 CASE WHEN pm IS NULL THEN '' ELSE left(sha1(sku), 16) END AS "Variant Key", sku AS "Variant SKU",
 coalesce(pm, '') AS "Print Method", CASE WHEN pm IS NULL THEN '' ELSE '0' END AS "Price Modifier Total",
 coalesce(q1, '') AS "QtyBreak1", coalesce(p1, '') AS "Price1", coalesce(q3, '') AS "QtyBreak3",
 coalesce(p3, '') AS "Price3",
 (SELECT max(n) FROM v) AS max_tiers, pm IS NULL AS bare_json FROM w""")
def variant_rows_outer(spark, sf) -> DataFrame:
    """First-version documents: one row per print method, one bare row without prices."""
    docs = _documents(spark, sf)
    size = V.export_size(docs).first()["max_tiers"]
    rows = V.expand_variants(docs, size, ["p_partkey"])
    shown = ["Source", "Product URL", "Product Name", "Supplier SKU", "Colors Total", "Napkin Colors",
             "Imprint Colors", "Gallery Images", "Has Pricing", "Minimum Order Qty", "Variant Key", "Variant SKU",
             "Print Method", "Price Modifier Total", "QtyBreak1", "Price1", "QtyBreak3", "Price3"]
    return rows.select("p_partkey", *[F.col(f"`{c}`") for c in shown], F.lit(size).cast("bigint").alias("max_tiers"),
                       (F.col("Variant JSON") == "{}").alias("bare_json"))


@query(f"""WITH {PRICE_SQL}, n AS (
 SELECT p_partkey, count(DISTINCT method) AS methods, coalesce(max(k), 0) AS widest FROM part LEFT JOIN (
  SELECT *, count(*) OVER (PARTITION BY l_partkey, method) AS k FROM price_rows)
  ON p_partkey = l_partkey GROUP BY 1)
SELECT CAST(max(widest) AS BIGINT) AS max_tiers, CAST(sum(greatest(methods, 1)) AS BIGINT) AS total_variants,
 count(*) AS products, false AS empty_match, false AS no_tiers FROM n""")
def export_size_scan(spark, sf) -> DataFrame:
    found = V.export_size(_documents(spark, sf))
    return found.withColumn("max_tiers", F.col("max_tiers").cast("bigint"))


@query(f"""SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS float_text,
 CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
  ELSE CAST(p_retailprice AS VARCHAR) END AS price_text, CAST(p_size AS VARCHAR) AS quantity_text,
 CAST(p_size / 100.0 AS DOUBLE) AS amount, {SLUG_SQL} AS slug, least(20, greatest(1, p_size)) AS clamped,
 CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS big, {URL_SQL} || '/1.png' AS main_image,
 CAST(2 AS BIGINT) AS gallery_size, '2024-03-05T07:08:09' || CASE WHEN p_size > 25 THEN '.250000' ELSE '' END AS iso,
 CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS flag_cell FROM part""")
def cell_formatting(spark, sf) -> DataFrame:
    parts = priced_parts(spark, sf)
    images = F.array(*[F.concat("product_url", F.lit(f"/{i}.png")) for i in (1, 2, 3)])
    big = F.col("p_size") > 25
    moment = F.when(big, F.lit("2024-03-05 07:08:09.25")).otherwise("2024-03-05 07:08:09").cast("timestamp_ntz")
    return parts.select(
        "p_partkey", X.float_text(F.col("p_retailprice")).alias("float_text"),
        X.price_text(F.col("p_retailprice")).alias("price_text"), X.quantity_text(F.col("p_size")).alias("quantity_text"),
        X.cents_amount(F.col("p_size")).alias("amount"), U.slug(F.col("product_url")).alias("slug"),
        X.clamp(F.col("p_size"), 1, 20).alias("clamped"), X.yes_no(big).alias("big"),
        X.main_image(images).alias("main_image"), F.size(X.gallery(images)).cast("bigint").alias("gallery_size"),
        X.iso_text(moment).alias("iso"), F.when(big, "true").otherwise("false").alias("flag_cell"))


def _mixed(spark, sf) -> DataFrame:
    """Parts as products of four sources, chosen by brand, with cents and lists."""
    docs = priced_parts(spark, sf)
    source = (F.when(F.col("p_brand").endswith("1"), "printify").when(F.col("p_brand").endswith("2"), "exposure")
              .when(F.col("p_brand").endswith("3"), "customcoasters").otherwise("Odd Shop"))
    colour = F.array(F.struct(F.concat(F.lit("#"), F.col("p_brand")).alias("hex"), F.lit("").alias("pms")),
                     F.struct(F.lit("").alias("hex"), F.col("p_type").alias("pms")))
    return docs.select(
        "p_partkey", source.alias("source"), F.concat(F.lit("id-"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.lit("").alias("sku"), F.col("p_partkey").alias("blueprint_id"), F.col("p_size").cast("bigint").alias("provider_id"),
        F.col("p_name").alias("title"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), (F.col("p_size") * 37).cast("bigint").alias("price_cents"),
        (F.col("p_size") > 25).alias("available"), colour.alias("colors"),
        F.array(F.col("p_brand"), F.lit("M")).alias("sizes"),
        F.array(F.lit("matte"), F.lit("glossy")).alias("imprint_styles"), "product_url",
        F.transform("pricing", lambda e: F.struct(
            F.when(e["shape"] == "F", F.lit('Round 4"')).otherwise("Square Tile").alias("shape"),
            F.lit('4" x 4"').alias("size"), e["quantity"].alias("quantity"), e["unit_price"].alias("unit_price")))
         .alias("pricing"))


_MIXED = """src AS (SELECT *, CASE WHEN p_brand LIKE '%1' THEN 'printify' WHEN p_brand LIKE '%2' THEN 'exposure'
  WHEN p_brand LIKE '%3' THEN 'customcoasters' ELSE 'odd shop' END AS s FROM part)"""


@query(f"""WITH {_MIXED}
SELECT p_partkey, upper(s) AS "Source",
 CASE s WHEN 'printify' THEN 'BP' || p_partkey WHEN 'customcoasters' THEN {URL_SQL} ELSE 'id-' || p_partkey END
  AS "Supplier SKU",
 CASE s WHEN 'printify' THEN 'id-' || p_partkey ELSE '' END AS "Variant SKU",
 CASE s WHEN 'printify' THEN 'BP' || p_partkey || '_P' || p_size ELSE '' END AS "Parent SKU",
 p_name AS "Product Name", p_type AS "Category-1",
 CASE WHEN s IN ('printify', 'exposure') THEN p_brand ELSE '' END AS "Brand",
 CASE WHEN s = 'printify' THEN CAST(p_size * 37 / 100.0 AS VARCHAR) ELSE '' END AS price_1,
 CASE s WHEN 'odd shop' THEN '#' || p_brand ELSE '' END AS "Hex Color",
 CASE s WHEN 'odd shop' THEN p_brand || ', M' ELSE '' END AS "Size",
 CASE s WHEN 'customcoasters' THEN 'matte|glossy' ELSE '' END AS "Print methods",
 CASE WHEN s = 'printify' AND p_size <= 25 THEN 'No' ELSE 'Yes' END AS "Active",
 CASE s WHEN 'odd shop' THEN {URL_SQL} ELSE '' END AS "Gallery Images",
 CAST(206 AS BIGINT) AS width FROM src""".replace(
    "CAST(p_size * 37 / 100.0 AS VARCHAR)", "CAST(CAST(p_size * 37 / 100.0 AS DOUBLE) AS VARCHAR)"))
def product_csv_projection(spark, sf) -> DataFrame:
    """A mixed table through the per-source maps, one row per product."""
    flat = S.to_sheet(_mixed(spark, sf), expanded=False, keep=["p_partkey"])
    shown = ["Source", "Supplier SKU", "Variant SKU", "Parent SKU", "Product Name", "Category-1", "Brand", "Hex Color",
             "Size", "Print methods", "Active", "Gallery Images"]
    return flat.select("p_partkey", *[F.col(f"`{c}`") for c in shown], F.col("Price1").alias("price_1"),
                       F.lit(len(flat.columns) - 1).cast("bigint").alias("width"))


@query(f"""WITH {PRICE_SQL}, {_MIXED}, {_SHAPE_TIERS},
g AS (SELECT l_partkey, CASE WHEN shape = 'F' THEN 'Round 4"' ELSE 'Square Tile' END AS kind,
  CAST(min(quantity) AS VARCHAR) AS minq, max(CASE WHEN place = 2 THEN CAST(quantity AS VARCHAR) END) AS q2,
  max(CASE WHEN place = 2 THEN {_FLOAT_TEXT} END) AS p2,
  max(CASE WHEN place = 16 THEN CAST(quantity AS VARCHAR) END) AS q16 FROM shape_tiers GROUP BY 1, 2),
e AS (SELECT *, {URL_SQL} AS url FROM src LEFT JOIN g ON s = 'customcoasters' AND p_partkey = l_partkey)
SELECT p_partkey, CASE WHEN s <> 'customcoasters' THEN CASE s WHEN 'printify' THEN 'id-' || p_partkey ELSE '' END
  ELSE url || '|' || CASE WHEN kind IS NULL THEN 'Default' WHEN kind = 'Square Tile' THEN 'Square-Tile'
   ELSE 'Round-4in' END || '|' || CASE WHEN kind IS NULL THEN '' ELSE '4inx4in' END END AS "Variant SKU",
 CASE s WHEN 'customcoasters' THEN coalesce(kind, 'Default') ELSE '' END AS "Variant Type",
 CASE s WHEN 'customcoasters' THEN CASE WHEN kind IS NULL THEN '' ELSE '4" x 4"' END
  WHEN 'odd shop' THEN p_brand || ', M' ELSE '' END AS "Size",
 CASE s WHEN 'customcoasters' THEN coalesce(minq, '') WHEN 'printify' THEN '1' ELSE '' END AS "Minimum Order Qty",
 coalesce(q2, '') AS "QtyBreak2", coalesce(p2, '') AS "Price2", coalesce(q16, '') AS "QtyBreak16" FROM e""")
def product_rows_expanded(spark, sf) -> DataFrame:
    """The same table with shape and size groups spread over rows."""
    rows = S.to_sheet(_mixed(spark, sf), expanded=True, keep=["p_partkey"], tier_limit=fixed.FIXED_TIERS)
    return rows.select("p_partkey", *[F.col(f"`{c}`") for c in (
        "Variant SKU", "Variant Type", "Size", "Minimum Order Qty", "QtyBreak2", "Price2", "QtyBreak16")])


@query(f"""WITH {PRICE_SQL},
f AS (SELECT l_partkey, coalesce(nullif({METHOD_SQL}, ''), 'Standard') AS pm, quantity, cents,
        row_number() OVER (PARTITION BY l_partkey, method ORDER BY quantity, shape) AS place FROM price_rows),
v AS (SELECT l_partkey, pm, max(CASE WHEN place = 2 THEN CAST(quantity AS VARCHAR) END) AS q2,
        max(CASE WHEN place = 2 THEN {_PRICE_TEXT} END) AS p2 FROM f GROUP BY 1, 2)
SELECT p_name AS "Product Name", p_brand AS "Supplier SKU", {URL_SQL} AS "Product URL",
 coalesce(pm, '') AS "Print Method", coalesce(q2, '') AS "QtyBreak2", coalesce(p2, '') AS "Price2"
 FROM part LEFT JOIN v ON p_partkey = l_partkey""")
def csv_round_trip(spark, sf) -> DataFrame:
    """The dynamic-tier export written as CSV and read back."""
    docs = _documents(spark, sf).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn(
        "deleted_at", F.lit(None).cast("timestamp_ntz"))
    path = staging_path(spark, "csv")
    size = export.products_csv(docs, path, "CustomNapkinsNow", rows_per_file=5000)
    back = csv_files.read(spark, path, fixed.dynamic_columns(size["max_tiers"]))
    return back.select(*[F.col(f"`{c}`") for c in (
        "Product Name", "Supplier SKU", "Product URL", "Print Method", "QtyBreak2", "Price2")])


@query(f"""WITH {_MIXED}
SELECT p_partkey, upper(s) AS source, CAST(CASE s WHEN 'printify' THEN 11 WHEN 'exposure' THEN 6
 WHEN 'customcoasters' THEN 6 ELSE 8 END AS BIGINT) AS filled FROM src ORDER BY p_partkey LIMIT 20""")
def preview_rows(spark, sf) -> DataFrame:
    """The first 20 products as maps without empty cells."""
    flat = S.to_sheet(_mixed(spark, sf), expanded=False, keep=["p_partkey"])
    kept = S.preview(flat, 20, [F.col("p_partkey")])
    return kept.select(F.col("row")["p_partkey"].cast("bigint").alias("p_partkey"), F.col("row")["Source"].alias("source"),
                       (F.size(F.map_keys("row")) - 1).cast("bigint").alias("filled"))


@query(f"""WITH {PRICE_SQL}, f AS (SELECT l_partkey, method, min(place) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY method) AS place FROM (
   SELECT DISTINCT l_partkey, method FROM price_rows)) GROUP BY 1, 2)
SELECT p_partkey, coalesce(coalesce(nullif({METHOD_SQL}, ''), 'Standard'), '') AS print_method FROM (
 SELECT p_partkey, arg_max(method, CASE WHEN place <= 2 THEN place END) AS method
 FROM part LEFT JOIN f ON p_partkey = l_partkey GROUP BY p_partkey)""".replace(
    f"coalesce(coalesce(nullif({METHOD_SQL}, ''), 'Standard'), '')",
    f"CASE WHEN method IS NULL THEN '' ELSE coalesce(nullif({METHOD_SQL}, ''), 'Standard') END"))
def preview_variant(spark, sf) -> DataFrame:
    """Each product's second variant row, or its last where it has fewer."""
    rows = V.expand_variants(_documents(spark, sf), 1, ["p_partkey"], only=1)
    return rows.select("p_partkey", F.col("`Print Method`").alias("print_method"))


@query(f"""WITH {_AXES}, three AS (
  SELECT pm.l AS p, nc.l AS n, ic.l AS c, row_number() OVER (ORDER BY pm.i, nc.i, ic.i) AS k FROM pm, nc, ic),
skus AS (SELECT p_partkey, k, replace(replace({SLUG_SQL} || '|print_method:' || p || '|napkin:' || n
  || '|imprint:' || c, ' ', '-'), '/', '-') AS sku, n FROM part, three)
SELECT p_partkey, count(*) AS variants, min(left(sha1(sku), 16)) AS first_key, min(sku) AS first_sku, max(sku) AS last_sku,
 max(CASE WHEN k = 137 THEN sku END) AS sku_137, CAST(round(sum(0.25 * (length(n) - 7)), 2) AS DOUBLE) AS modifiers FROM skus GROUP BY p_partkey""")
def variant_rows_numbered(spark, sf) -> DataFrame:
    """The whole matrix of 5 x 25 x 5 as numbered rows, with no list of them, summed up by part."""
    regions = table(spark, sf, "region").agg(F.array_sort(F.collect_list("r_name")))
    nations = table(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_name")))
    option = lambda label, extra: F.struct(
        label.alias("label"), F.lit("1").alias("option_value_id"), F.lit("1").alias("option_id"),
        extra.alias("price_modifier"), F.lit(None).cast("string").alias("swatch_image_url"), F.lit("").alias("step_label"))
    zero = F.lit(0.0)
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", regions.scalar().alias("r"), nations.scalar().alias("n")).withColumn(
        "options", F.create_map(
            F.lit("print_method"), F.transform("r", lambda x: option(x, zero)),
            F.lit("napkin"), F.transform("n", lambda x: option(x, 0.25 * (F.length(x) - 7))),
            F.lit("imprint"), F.transform(F.reverse("r"), lambda x: option(F.concat(F.lit("ink "), x), zero))))
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    rows = C.variant_rows(parts, ["p_partkey"], F.col("options"), F.lit(None).cast(f"array<{TIER}>"), slug, F.lit(None).cast("string"), ordered=["p_partkey"])
    v = F.col("variant")
    return rows.groupBy("p_partkey").agg(
        F.count("*").alias("variants"), F.min(v["variant_key"]).alias("first_key"), F.min(v["sku"]).alias("first_sku"), F.max(v["sku"]).alias("last_sku"),
        F.max(F.when(F.col("ordinal") == 136, v["sku"])).alias("sku_137"), F.round(F.sum(v["price_modifier_total"]), 2).alias("modifiers"))
