"""Extraction over pages that are rendered from the driver tables: reading a page
must give back the rows it was written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from querybook import query
from querybook.derived import PRICE_SQL, SLUG_SQL, price_rows, spread, table
from shelfdelta.functions import html as H
from shelfdelta.operators import discovery as DI, page_parts as G
from shelfdelta.plans import extraction as X

_HOST = "static.customnapkinsnow.com"
_COASTER_HOST = "static.customcoastersnow.com"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _many(items: Column, render) -> Column:
    return F.coalesce(F.array_join(F.transform(items, render), ""), F.lit(""))


def _dollars(cents: Column) -> Column:
    return (cents / 100).cast("decimal(18,2)")


def _marked(pages: DataFrame) -> DataFrame:
    return pages.withColumn("m", H.markup(F.col("html")))


def step_pages(spark, sf) -> DataFrame:
    """One page per part: heading, specification table, price table (one tier per
    quantity), option steps; big parts carry the fallback forms instead."""
    best = price_rows(spark, sf).groupBy("l_partkey", "quantity").agg(F.min("cents").alias("cents"))
    tiers = best.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("quantity", "cents"))).alias("tiers"))
    rows = spread(table(spark, sf, "part"), "p_partkey").join(tiers, F.col("p_partkey") == F.col("l_partkey"), "left")
    big = F.col("p_size") > 40
    table_html = _text(
        '<table id="tblPrice" class="t"><tr><th>Qty</th>',
        _many(F.col("tiers"), lambda t: _text("<th>", t["quantity"], "</th>")), "</tr>\n<tr><td>Price</td>",
        _many(F.col("tiers"), lambda t: _text("<td>$", _dollars(t["cents"]), "</td>")), "</tr></table>")
    cells_html = _text("<table><tr>", _many(F.col("tiers"), lambda t: _text(
        '<td id="price_connect_', t["quantity"], '"> $ ', _dollars(t["cents"]), "</td>")), "</tr></table>")
    option = lambda n, label, extra="": _text(
        '<div class="opt" data-product-option-value-id="', n, '" data-option-id="o1" data-price="$0.25"', extra, ">",
        '<img data-src="https://static.customnapkinsnow.com/i/', n, '.png">', label, "</div>")
    steps = _text(
        '<h3 class="badgeh3">Step 1: <b>Print Method</b></h3>', option("11", F.col("p_brand")),
        option("12", "ignored", ' data-original-option-value-name="Blind Emboss"'), option("11", F.col("p_brand")),
        '<h4>Other heading</h4><h3 class="x badgeh2"> Step 2 Choose Napkin Color</h3>', option("21", F.col("p_type")),
        '<input class="form-control quantities" data-product-option-value-id="99" value="1">',
        "<h4>Step 3 Ink Color</h4>", option("31", "Gold &amp; Red"), option("32", "White"))
    html = _text(
        "<!DOCTYPE html><html><head><title>", F.col("p_name"), " - CustomNapkinsNow.Com</title>",
        '<meta name="description" content=" About ', F.col("p_name"), ' &amp; more ">',
        '<script>var custom_ads_data = {"id":1,"images":["https:\\/\\/img\\/', F.col("p_partkey"),
        '.png","https:\\/\\/img\\/loader.gif","https:\\/\\/img\\/b.jpg"]}; var x = {"database_tag":"T',
        F.col("p_partkey"), '"', F.when(F.col("p_size") <= 20, _text(',"sku":" SK-', F.col("p_partkey"), ' "')).otherwise(""),
        "};</script></head><body><!-- <h1>No</h1> --><h1> ", F.col("p_name"), " <i>", F.col("p_size"), "</i></h1>",
        '<div class="pdescription-content"><div>', F.col("p_name"), F.col("p_size"),
        "</div><p>A fine product for every single table.</p><div>Made well.</div> SPECIFICATIONS <p>x</p></div>",
        "<table><tr><th>Specifications</th><th>Details</th></tr><tr><td>Material:</td><td>", F.col("p_type"),
        "</td></tr><tr><td>Item Size</td><td>4 x ", F.col("p_size"), " in</td></tr></table>",
        F.when(big, cells_html).otherwise(table_html), steps, "</body></html>")
    url = _text("https://www.customnapkinsnow.com/product/", F.lower("p_type"), "/",
                F.replace("p_name", F.lit(" "), F.lit("-")), "-", F.col("p_partkey"))
    return rows.select("p_partkey", url.alias("url"), html.alias("html"), F.lit("2024-01-05").alias("lastmod"))


_TIERS = f"""{PRICE_SQL}, tiers AS (SELECT l_partkey, quantity, min(cents) AS cents FROM price_rows GROUP BY 1, 2)"""


@query(f"""WITH {_TIERS} SELECT p_partkey, quantity, CAST(cents / 100.0 AS DOUBLE) AS unit_price
 FROM part JOIN tiers ON p_partkey = l_partkey""")
def html_price_tables(spark, sf) -> DataFrame:
    """Price tables, and cells named after their quantity where there is no table."""
    rows = _marked(step_pages(spark, sf)).select("p_partkey", G.base_tiers(F.col("m")).alias("t"))
    return rows.select("p_partkey", F.inline("t"))


@query("""SELECT p_partkey, grp, CAST(pos AS INT) AS pos, label, id, CAST(0.25 AS DOUBLE) AS price_modifier,
 'https://static.customnapkinsnow.com/i/' || id || '.png' AS swatch, step FROM (
 SELECT p_partkey, 'print_method' AS grp, 0 AS pos, p_brand AS label, '11' AS id, 'Step 1: Print Method' AS step FROM part
 UNION ALL SELECT p_partkey, 'print_method', 1, 'Blind Emboss', '12', 'Step 1: Print Method' FROM part
 UNION ALL SELECT p_partkey, 'napkin', 0, p_type, '21', 'Step 2 Choose Napkin Color' FROM part
 UNION ALL SELECT p_partkey, 'imprint', 0, 'Gold & Red', '31', 'Step 3 Ink Color' FROM part
 UNION ALL SELECT p_partkey, 'imprint', 1, 'White', '32', 'Step 3 Ink Color' FROM part)""")
def option_groups(spark, sf) -> DataFrame:
    """Options under their step headings, hidden inputs and repeats left out."""
    rows = _marked(step_pages(spark, sf)).select("p_partkey", G.options_by_group(
        G.options(F.col("m"), _HOST)).alias("o"))
    listed = rows.select("p_partkey", F.explode("o").alias("grp", "options"))
    out = listed.select("p_partkey", "grp", F.posexplode("options").alias("pos", "x"))
    return out.select("p_partkey", "grp", "pos", F.col("x.label").alias("label"), F.col("x.option_value_id").alias("id"),
                      F.col("x.price_modifier").alias("price_modifier"), F.col("x.swatch_image_url").alias("swatch"),
                      F.col("x.step_label").alias("step"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'SK-' || p_partkey ELSE 'SKUT' || p_partkey END AS sku,
 'T' || p_partkey AS database_tag, CASE WHEN p_size <= 20 THEN 'json_sku' ELSE 'db_tag' END AS sku_source,
 'https://img/' || p_partkey || '.png|https://img/b.jpg' AS images FROM part""")
def sku_and_images(spark, sf) -> DataFrame:
    html = F.col("html")
    rows = _marked(step_pages(spark, sf)).select("p_partkey", G.sku(html, F.col("m")).alias("s"),
                                        F.array_join(G.script_images(html), "|").alias("images"))
    return rows.select("p_partkey", "s.*", "images")


@query(f"""WITH {_TIERS}, q AS (SELECT l_partkey, count(*) AS n, min(quantity) FILTER (quantity > 1 OR NOT bulk) AS minq FROM (
  SELECT *, count(*) FILTER (quantity >= 25) OVER (PARTITION BY l_partkey) >= 2 AS bulk FROM tiers) GROUP BY 1)
SELECT 'https://www.customnapkinsnow.com/product/' || lower(p_type) || '/' || {SLUG_SQL} AS url, 'scraped' AS outcome,
 p_name || p_size AS name, 'About ' || p_name || ' & more' AS meta_description,
 'A fine product for every single table.' || chr(10) || 'Made well.' AS description, p_type AS material,
 '4 x ' || p_size || ' in' AS size, upper(p_type[1:1]) || lower(p_type[2:]) AS category,
 CAST(4 AS INT) AS variants, {SLUG_SQL} || '|print_method:' || p_brand || '|napkin:' || p_type || '|imprint:Gold-&-Red' AS first_sku,
 CAST(0.75 AS DOUBLE) AS modifier, coalesce(n, 0) AS tiers, minq AS min_order_qty,
 'Blind Emboss|' || p_brand AS print_methods, 'print_method|napkin|imprint' AS detected,
 'https://img/' || p_partkey || '.png' AS main_image, p_type || '|Gold & Red|White' AS colours
FROM part LEFT JOIN q ON p_partkey = l_partkey""")
def option_step_products(spark, sf) -> DataFrame:
    """Whole products of option-step pages."""
    out = X.run_site(step_pages(spark, sf), "customnapkinsnow")
    p = F.col("product")
    first = F.get(p["variants"], F.lit(0))
    return out.select(
        "url", "outcome", p["name"].alias("name"), p["meta_description"].alias("meta_description"),
        p["description"].alias("description"), p["material"].alias("material"), p["size"].alias("size"),
        p["category"].alias("category"), F.size(p["variants"]).alias("variants"), first["sku"].alias("first_sku"),
        first["price_modifier_total"].alias("modifier"), F.size(first["tiers"]).cast("bigint").alias("tiers"),
        p["min_order_qty"].alias("min_order_qty"), F.array_join(p["print_methods"], "|").alias("print_methods"),
        F.array_join(p["option_groups_detected"], "|").alias("detected"), p["main_image"].alias("main_image"),
        F.array_join(p["available_colors"], "|").alias("colours"))


def shape_pages(spark, sf) -> DataFrame:
    """One page per part with a table per shape (line status), one row per method;
    some charts are flat, some hidden without prices."""
    entry = F.struct("method", "quantity", "cents")
    rows = price_rows(spark, sf).groupBy("l_partkey", "shape").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    shapes = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("shape", "es"))).alias("shapes"))
    rows = spread(table(spark, sf, "part"), "p_partkey").join(shapes, F.col("p_partkey") == F.col("l_partkey"))

    def one_table(s: Column) -> Column:
        methods = F.array_distinct(F.transform(s["es"], lambda e: e["method"]))
        line = lambda m: _text('<tr class="r price_chart_size_row"><th>', m, "</th>", _many(
            F.filter(s["es"], lambda e: e["method"] == m),
            lambda e: _text('<td id="price_connect_77_', e["quantity"], '">$', (e["cents"] / 100), "</td>")),
            "<td>For the best pricing</td></tr>")
        return _text("<table><tr><th>Size / Qty</th><th>1</th></tr>", _many(methods, line),
                     "<tr><td>other</td><td>$9</td></tr></table>")

    tabs = _text("<nav><a href='/x'>x</a></nav><nav>", _many(F.col("shapes"), lambda s: _text(
        '<a class="l" href="#nav-price-', s["shape"], '">Shape <b>', s["shape"], "</b></a>")),
        '</nav><div id="nav-tabContent" class="tab">', _many(F.col("shapes"), lambda s: _text(
            '<div class="tab-pane" id="nav-price-', s["shape"], '"><div>note</div>', one_table(s), "</div>")), "</div>")
    hidden = F.col("p_size") > 45
    chart = F.when(hidden, '<div class="price_chart" style="display: none"><table><tr><td>soon</td></tr></table></div>'
                   ).otherwise(_text('<div class="a price_chart b">', F.when(F.col("p_size") > 40, _many(
                       F.col("shapes"), one_table)).otherwise(tabs), "</div>"))
    html = _text("<html><body><h1>", F.col("p_name"), "</h1>", chart,
                 '<select><option data-option-value-id="1">--Please Select--</option>',
                 '<option data-option-value-id="2">Matte Finish</option><option data-option-value-id="3">Round</option>',
                 '<option data-option-value-id="4">Full Color</option><option data-option-value-id="5">Matte Finish</option>',
                 '</select><div class="pdescription-content">Material : Cork<br>Thickness: 4 mm<br>Shapes: all</div>',
                 '<img data-src="https://', _COASTER_HOST, "/product_", F.col("p_partkey"), '.jpg"><img data-src="https://',
                 _COASTER_HOST, '/product_logo.png"></body></html>')
    return rows.select("p_partkey", "p_size", _text(
        "https://www.customcoastersnow.com/product/", F.lower("p_type"), "/custom/", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), "-x").alias("base"),
        html.alias("html")).select("p_partkey", F.concat("base", F.col("p_partkey").cast("string")).alias("url"), "html")


_SHAPES = f"""{PRICE_SQL}, s AS (SELECT p_partkey, p_size, CASE WHEN p_size > 40 THEN 'Default' ELSE 'Shape' || shape END AS shape,
 method AS size, quantity, cents FROM part JOIN price_rows ON p_partkey = l_partkey
 WHERE p_size <= 45 AND quantity >= 2 AND cents / 100.0 BETWEEN 0.001 AND 10000)"""


@query(f"""WITH {_SHAPES} SELECT p_partkey, shape, size, quantity, CAST(cents / 100.0 AS DOUBLE) AS unit_price FROM s""")
def shape_tab_tables(spark, sf) -> DataFrame:
    """Shape, size, quantity and price of tabbed and flat charts; single-piece
    placeholders and impossible prices drop out."""
    rows = _marked(shape_pages(spark, sf)).select("p_partkey", G.shape_prices(F.col("m")).alias("t"))
    return rows.select("p_partkey", F.inline("t"))


@query(f"""WITH {_SHAPES}, a AS (SELECT p_partkey, count(*) AS prices, min(quantity) AS minq,
  string_agg(DISTINCT shape, '|' ORDER BY shape) AS shapes FROM s GROUP BY 1)
SELECT part.p_partkey, CASE WHEN p_size > 45 THEN 'skipped' ELSE 'scraped' END AS outcome,
 CASE WHEN p_size > 45 THEN 'hidden price chart' END AS reason,
 CASE WHEN p_size <= 45 THEN 'Cork' END AS material, CASE WHEN p_size <= 45 THEN '4 mm' END AS thickness,
 CASE WHEN p_size <= 45 THEN 'Matte Finish|Full Color' END AS styles, CASE WHEN p_size <= 45 THEN coalesce(prices, 0) END AS prices,
 minq AS min_order_qty, CASE WHEN p_size <= 45 THEN coalesce(shapes, '') END AS shapes,
 CASE WHEN p_size <= 45 THEN 'https://static.customcoastersnow.com/product_' || part.p_partkey || '.jpg' END AS main_image,
 CASE WHEN p_size <= 45 THEN replace(upper(p_brand[1:1]) || lower(p_brand[2:]), '#', ' ') || ' X' || part.p_partkey END AS subcategory
FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey LEFT JOIN a ON part.p_partkey = a.p_partkey""")
def shape_tab_products(spark, sf) -> DataFrame:
    pages = shape_pages(spark, sf)
    out = X.run_site(pages, "customcoasters").join(pages.select("url", "p_partkey"), "url")
    p = F.col("product")
    return out.select(
        "p_partkey", "outcome", "reason", p["material"].alias("material"), p["thickness"].alias("thickness"),
        F.array_join(p["imprint_styles"], "|").alias("styles"), F.when(p.isNotNull(), F.size(p["pricing"]).cast("bigint"))
         .alias("prices"), p["min_order_qty"].alias("min_order_qty"), F.array_join(p["available_shapes"], "|").alias("shapes"),
        p["main_image"].alias("main_image"), p["subcategory"].alias("subcategory"))


def embedded_pages(spark, sf) -> DataFrame:
    """One page per part with JSON-LD and an editor container whose JSON holds one
    price list per size; the URL names the size for small parts only."""
    best = price_rows(spark, sf).groupBy("l_partkey", "quantity").agg(F.min("cents").alias("cents"))
    tiers = best.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("quantity", "cents"))).alias("tiers"))
    rows = spread(table(spark, sf, "part"), "p_partkey").join(tiers, F.col("p_partkey") == F.col("l_partkey"))
    listing = lambda plus: _text('{"pricing":{', F.array_join(F.transform("tiers", lambda t: _text(
        '"qty_', t["quantity"], '":{"qty":{"from":', t["quantity"], '},"usd":', (t["cents"] + plus) / 100, "}")), ","), "}}")
    props = _text('{"product":{"productImages":[],"variants":[{"name":"6X24","image":"v6.png"},{"name":"18X24","image":"v18.png"}],',
                  '"pricing":{"quantities":[', F.array_join(F.transform("tiers", lambda t: t["quantity"].cast("string")), ","),
                  ',99999],"variants":{"pricing_6x24":', listing(0), ',"pricing_18x24":', listing(7), "}}}}")
    ld = _text('{"@context":"https://schema.org","@type":"', F.when(F.col("p_size") > 45, "Thing").otherwise("Product"),
               '","name":"', F.col("p_name"), F.when(F.col("p_size") > 30, " Sign").otherwise(""),
               '","brand":{"name":"', F.col("p_brand"), '"},"offers":{"availability":"https://schema.org/',
               F.when(F.col("p_size") > 10, "InStock").otherwise("OutOfStock"), '"},"image":"ld.png"}')
    html = _text('<html><head><script type="application/ld+json">', ld, '</script></head><body>',
                 '<div class="w" id="product-editor-container" data-symfony--ux-react--react-props-value="',
                 F.replace(F.replace(props, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), '"></div></body></html>')
    url = _text("https://www.yardsignplus.com/yard-signs/shop/", F.lower("p_type"), "-signs/P", F.col("p_partkey"),
                F.when(F.col("p_size") < 20, "?variant=18x24").otherwise(""))
    return rows.select("p_partkey", url.alias("url"), html.alias("html"))


@query(f"""WITH {_TIERS} SELECT p_partkey, quantity,
 CAST((cents + CASE WHEN p_size < 20 THEN 7 ELSE 0 END) / 100.0 AS DOUBLE) AS price
 FROM part JOIN tiers ON p_partkey = l_partkey""")
def embedded_json(spark, sf) -> DataFrame:
    """Tiers of the size's price list, or of the first list."""
    from shelfdelta.functions.urls import size_in_url
    rows = embedded_pages(spark, sf).select("p_partkey", G.embedded_tiers(
        G.embedded_props(F.col("html")), size_in_url(F.col("url"))).alias("t"))
    return rows.select("p_partkey", F.inline("t"))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'skipped' ELSE 'scraped' END AS outcome,
 CASE WHEN p_size <= 45 THEN 'P' || p_partkey END AS product_id,
 CASE WHEN p_size <= 45 THEN p_name || CASE WHEN p_size > 30 THEN ' Sign' ELSE '' END END AS name,
 CASE WHEN p_size <= 45 THEN p_brand END AS brand, CASE WHEN p_size <= 45 THEN 'Yard Signs' END AS category,
 CASE WHEN p_size <= 45 THEN upper(p_type[1:1]) || lower(p_type[2:]) || ' Signs' END AS subcategory,
 CASE WHEN p_size < 20 THEN '18x24' END AS size, CASE WHEN p_size <= 45 THEN p_size > 10 END AS is_active,
 CASE WHEN p_size > 30 AND p_size <= 45 THEN 'Corrugated Plastic (Coroplast)' END AS material,
 CASE WHEN p_size <= 45 THEN CASE WHEN p_size < 20 THEN 'v18.png' ELSE 'v6.png' END END AS main_image
FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey""")
def embedded_products(spark, sf) -> DataFrame:
    pages = embedded_pages(spark, sf)
    out = X.run_site(pages, "yardsignplus").join(pages.select("url", "p_partkey"), "url")
    fields = ["product_id", "name", "brand", "category", "subcategory", "size", "is_active", "material", "main_image"]
    return out.select("p_partkey", "outcome", *[F.col("product")[f].alias(f) for f in fields])


@query("""SELECT CASE WHEN p_size > 45 THEN 'skipped' ELSE 'scraped' END AS outcome, count(*) AS n
 FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey GROUP BY 1""")
def crawl_counters(spark, sf) -> DataFrame:
    return DI.crawl_counters(X.run_site(embedded_pages(spark, sf), "yardsignplus"))


@query("""WITH t AS (SELECT l_partkey, l_shipdate AS a, l_shipdate + to_milliseconds(CAST(floor(l_extendedprice) AS BIGINT)) AS b
 FROM lineitem)
SELECT l_partkey, count(*) AS n, CAST(sum(date_diff('millisecond', a, b)) AS BIGINT) AS ms FROM t GROUP BY 1""")
def run_durations(spark, sf) -> DataFrame:
    from shelfdelta.functions.status import duration_ms
    seconds = F.floor("l_extendedprice").cast("bigint") / F.lit(1000).cast("decimal(10,0)")
    ended = F.col("l_shipdate") + F.make_dt_interval(secs=seconds)
    rows = table(spark, sf, "lineitem").select("l_partkey", duration_ms(F.col("l_shipdate"), ended).alias("ms"))
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
