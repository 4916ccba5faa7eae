"""Odd inputs that once gave wrong rows, lost rows or ended the job."""

import json

import pytest
from pyspark.sql import functions as F

from shelfdelta.functions import document, html as H, payload as P, text as X
from shelfdelta.operators import discovery, page_parts as G, sheet as S
from shelfdelta.plans import extraction, tracked
from shelfdelta.sources import csv_files, sitemap
from shelfdelta.sources.tables import Store, latest_sessions, read_or_empty
from shelfdelta.streaming.writer import TrackedStream


def ts(n):
    return F.lit(f"2024-01-0{n}").cast("timestamp_ntz")


def docs(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "doc string").coalesce(1)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_heading_with_very_many_blanks(spark):
    page = "<h3>" + " " * 100_000 + "<b>Step 1: Colour</b></h3><div data-product-option-value-id='7'>Red</div>"
    found = one(spark, page, G.options)
    assert [(o.label, o.option_value_id) for o in found] == [("Red", "7")]
    assert found[0].step_label.startswith("Step 1")


def test_pages_that_cannot_be_read_are_failed(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Sign"}</script>'
    editor = '<div id="product-editor-container" data-symfony--ux-react--react-props-value="{&quot;product&quot;:"></div>'
    pages = spark.createDataFrame([("u1", None), ("u2", ld + editor), ("u3", ld), ("u4", "<p>none</p>")], "url string, html string")
    got = {r.url: (r.outcome, r.product is None) for r in extraction.embedded_json_pages(pages).collect()}
    assert got == {"u1": ("failed", True), "u2": ("failed", True), "u3": ("scraped", False), "u4": ("skipped", True)}
    assert {r.outcome for r in extraction.option_step_pages(pages.filter("html is null")).collect()} == {"failed"}


def test_entities(spark):
    text = "Caf&eacute; &reg; &#8217;&#x1F600; &amp;lt; a &nosuch; b & c&nbsp;d &#xD800;"
    assert one(spark, text, H.unescape) == "Café ® ’😀 &lt; a &nosuch; b & c\u00a0d &#xD800;"


def test_csv_keeps_blanks(spark, tmp_path):
    csv_files.write(spark.createDataFrame([(" a ", "x")], "a string, b string"), str(tmp_path / "c"))
    assert csv_files.read(spark, str(tmp_path / "c"), ["a", "b"]).first().a == " a "


def test_keys_are_escaped(spark):
    text = one(spark, '{"a\\"b":1,"c":"x"}', lambda c: P.canonical_text(P.parse(c)))
    assert json.loads(text) == {'a"b': 1, "c": "x"}


def test_cells_never_fail(spark):
    assert one(spark, 1e39, X.price_text, "double") == "1e+39"
    assert one(spark, "abc", X.cents_text) == ""
    rows = spark.createDataFrame([("printify", 5, "abc"), ("printify", 6, "250")], "source string, blueprint_id long, price_cents string")
    assert sorted(r.Price1 for r in S.to_sheet(rows, False, ["printify"]).collect()) == ["", "2.5"]


def test_sizes_fall_back_row_by_row(spark):
    rows = spark.createDataFrame([("x", ["S", "M"], "9"), ("x", None, "9")], "source string, sizes array<string>, size string")
    assert [r.Size for r in S.to_sheet(rows, False).collect()] == ["S, M", "9"]


def test_typed_document(spark):
    row = one(spark, '{"price_cents":"1599","blueprint_id":3.0,"available":true,"provider_id":"x","title":5}', document.product)
    assert (row.price_cents, row.blueprint_id, row.available, row.provider_id, row.title) == (1599, 3, True, None, "5")


def test_last_copy_wins_without_order_and_unreadable_is_counted(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    got = tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 9}, {"product_id": "a", "v": 10}, "not json", "[1]"]), "r1", ts(1))
    assert got["storage"]["failed"] == 2
    assert [r.payload["v"] for r in store.catalog("s").collect()] == ["10"]


def test_backdated_and_repeated_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": "a"}]), "r1", ts(5))
    tracked.run(store, "s", docs(spark, [{"product_id": "b"}]), "r2", ts(1))
    alive = store.catalog("s").filter("deleted_at is null")
    assert [r.product_key for r in alive.collect()] == ["s:b"]
    again = tracked.run(store, "s", docs(spark, [{"product_id": "b"}]), "r2", ts(1))
    assert again["changes"]["unchanged"] == 1 and store.catalog("s").count() == 2


def test_stale_base_is_refused_and_session_closed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": "a"}]), "r1", ts(1))
    with pytest.raises(RuntimeError):
        store.write_catalog("s", "r2", store.catalog("s"), ts(2), base=0)
    assert store.sequence("s") == 1


def test_one_moment_for_a_run(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": "a"}]), "r1", F.current_timestamp())
    assert store.catalog("s").first().created_at == store.read("changes").first().created_at


def test_empty_stream_and_repeated_finalize(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": "a"}]), "r1", ts(1))
    writer = TrackedStream(store, "s", "r2", ts(2))

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "write_catalog", dies)
        with pytest.raises(RuntimeError):
            writer.finalize()
    assert {r.session_id: r.status for r in latest_sessions(store.read("sessions")).collect()}["r2"] == "failed"
    assert writer.finalize()["changes"]["deleted"] == 1


def test_only_a_missing_folder_reads_as_empty(spark, tmp_path):
    assert read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        read_or_empty(spark, "nosuchscheme://x/y", "a int").count()


def test_options_in_options_and_same_tags(spark):
    page = ('<h3>Step 1 Color</h3><div data-product-option-value-id="1"><div></div>Red</div>'
            '<div data-product-option-value-id="2" data-price="2"><span data-product-option-value-id="3">Blue</span></div>'
            '<input data-product-option-value-id=4 data-original-option-value-name="Tan"><p>far</p>'
            '<li data-product-option-value-id="5">never closed')
    got = [(o.option_value_id, o.label) for o in one(spark, page, G.options)]
    assert got[:4] == [("1", "Red"), ("2", "Blue"), ("3", "Blue"), ("", "Tan")]


def test_tables_in_tables(spark):
    page = ("<table><tr><th>Specifications</th></tr><tr><td>Material</td><td>Oak<table><tr><td>a</td><td>b</td></tr></table></td></tr>"
            "<tr><td>Size</td><td>9</td></tr></table><p>after</p>")
    assert len(one(spark, page, H.tables_of)) == 2
    rows = {r.key: r.value for r in one(spark, page, G.spec_rows)}
    assert rows["size"] == "9" and "material" in rows
    assert one(spark, '<div class="x"><div>a</div>b</div>c<div>d</div>', lambda c: H.element(c, "div", H.has_class("x"))) == (
        '<div class="x"><div>a</div>b</div>')


def test_links_without_quotes_and_with_angles_in_quotes(spark):
    pages = spark.createDataFrame([(1, "https://h/", '<a href=/x>1</a><a title="b>c" href="/y">2</a><a name=z>3</a><a href=\'/w\'>4</a>')],
                                  "page_id long, url string, html string")
    assert [r.href for r in discovery.links(pages).orderBy("pos").collect()] == ["/x", "/y", "/w"]


def test_every_ld_script_and_list(spark):
    tag = '<script type="application/ld+json">%s</script>'
    page = tag % '{"@type":"Thing"}' + tag % "no json" + tag % '[{"@type":"Crumb"},{"@type":"Product","sku":" s1 "}]'
    assert one(spark, page, lambda c: G.sku(c, c)).sku == "s1"


def test_a_deep_sitemap_and_a_cycle(spark):
    index = lambda *n: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in n) + "</sitemapindex>"
    files = [(f"f{i}", index(f"f{i + 1}", "f0")) for i in range(6)] + [("f6", "<urlset></urlset>"), ("lost", "<urlset></urlset>")]
    df = spark.createDataFrame(files, "url string, body string")
    assert {r.url: r.depth for r in sitemap.reachable(df, "f0").collect()} == {f"f{i}": i for i in range(7)}
    assert sitemap.reachable(df, "f0", 3).count() == 4
