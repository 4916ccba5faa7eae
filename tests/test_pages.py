from pyspark.sql import functions as F

from shelfdelta.functions import html as H
from shelfdelta.operators import page_parts as G
from shelfdelta.plans import extraction as X


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "h string").select(*cols).first()


def test_nested_elements_comments_and_scripts(spark):
    page = ('<div class="a price_chart"><div>in<div>deep</div></div>tail</div><div>after</div><!-- <h1>no</h1> -->'
            "<script>var s='<h1>no</h1>'</script><h1> Big <b>Cup</b> &amp; lid</h1>")
    inside, title = one(spark, page, H.node_text(H.element(F.col("h"), "div", H.has_class("price_chart")), "|"),
                        G.title(H.markup(F.col("h"))))
    assert inside == "in|deep|tail" and title == "BigCup& lid".replace("BigCup&", "BigCup& ").replace("  ", " ")


def test_class_names_match_whole(spark):
    assert one(spark, '<div class="price_chart_row">x</div>', H.element(F.col("h"), "div", H.has_class("price_chart")))[0] == ""


def test_price_cells_without_a_table(spark):
    page = '<td id="price_connect_50">$ 1,200.50</td><td id="price_connect_10">9</td><td id="price_connect_x">1</td>'
    assert [tuple(t) for t in one(spark, page, G.base_tiers(F.col("h")))[0]] == [(10, 9.0), (50, 1200.5)]


def test_flat_price_table_with_header_quantities(spark):
    table = ('<table><tr><th>Qty</th><th>1</th><th>25 pcs</th><th>50</th></tr><tr class="price_chart_size_row"><td>Price</td><td>$9</td>'
             "<td>$2.5</td><td>For the best pricing</td></tr><tr><td>x</td><td>$1</td></tr></table>")
    for page in (f'<div class="price_chart">{table}</div>', table):
        assert [tuple(t) for t in one(spark, page, G.shape_prices(F.col("h")))[0]] == [("Default", "Standard", 25, 2.5)]


def test_sku_places_in_order(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","sku":"L9"}</script>'
    cases = [('"sku": "J1" data-product-id="7"', ("J1", "7", "json_sku")), ('<meta itemprop="sku" content=" I2 ">', ("I2", None, "itemprop_sku")),
             ('<span itemprop="sku">I3</span>', ("I3", None, "itemprop_sku")), ('<div class="x" data-sku="D4">', ("D4", None, "data_sku")),
             ('<i data-product-id="7"></i>', ("SKU7", "7", "db_tag")), ("<p>nothing</p>", (None, None, "none"))]
    for text, want in cases:
        assert tuple(one(spark, text, G.sku(F.col("h"), H.markup(F.col("h"))))[0]) == want
    assert one(spark, ld.replace('"sku":', '"sku" :'), G.sku(F.col("h"), H.markup(F.col("h"))))[0].sku == "L9"


def test_image_places_in_order(spark):
    host = "static.h.com"
    lazy = f'<img data-src="https://{host}/a.png"><img data-src="https://{host}/logo.png"><img data-src="https://{host}/a.png">'
    cdn = f"url(https://{host}/fit-in/40x40/z.webp) https://{host}/fit-in/1x1/icon.png"
    for text, want in ((lazy + cdn, [f"https://{host}/a.png"]), (cdn, [f"https://{host}/fit-in/40x40/z.webp"]), ("", [])):
        got = one(spark, text, G.first_list(G.script_images(F.col("h")), G.lazy_images(F.col("h"), host), G.cdn_images(F.col("h"), host)))
        assert got[0] == want


def test_jobs_register_their_site(spark):
    assert {"customnapkinsnow", "customcoasters", "yardsignplus"} <= set(X.SITES)
    import datetime
    rows = X.declared_registry(spark, datetime.datetime(2024, 1, 1)).collect()
    assert all(r.status == "active" and r.metadata.tags for r in rows)


def test_pages_that_are_no_products(spark):
    pages = spark.createDataFrame([("https://h/product/a/b", "<h1>x</h1>"), ("https://h/q", "")], "url string, html string")
    out = X.run_site(pages, "customnapkinsnow")
    assert [(r.outcome, r.reason, r.product) for r in out.collect()] == [("skipped", "no title", None)] * 2
    assert X.products_of(out).count() == 0
