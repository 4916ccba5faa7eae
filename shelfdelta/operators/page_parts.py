"""Parts of stored product pages, as column expressions over the page markup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfdelta.functions import fixed, html as H, urls as U
from shelfdelta.functions import text as X
from shelfdelta.functions.binding import let
from shelfdelta.functions.predicates import sane_tier
from shelfdelta.operators import tiers as tr

_STEP = r"Step\s++\d++\b"
_PRICE = "array<struct<quantity:bigint,unit_price:double>>"
_SHAPED = "array<struct<shape:string,size:string,quantity:bigint,unit_price:double>>"


def title(page: Column) -> Column:
    return H.node_text(H.inner(page, "h1"))


def name(page: Column, suffixes: list[str]) -> Column:
    """The heading, else the page title without the shop's suffixes."""
    from_title = H.unescape(H.inner(page, "title"))
    for s in suffixes:
        from_title = F.replace(from_title, F.lit(s), F.lit(""))
    return F.coalesce(X.blank_to_null(title(page)), X.blank_to_null(X.strip(from_title)))


def meta_description(page: Column) -> Column:
    tag = F.get(H.all_tags(page, "meta", r"""\bname\s*=\s*["']description["']"""), F.lit(0))
    return X.strip(H.attribute(tag, "content"))


def valid_title(page: Column) -> Column:
    return F.length(title(page)) >= 3


def price_chart_problem(page: Column) -> Column:
    """Why a tab-priced page is skipped, or null."""
    chart = H.element(page, "div", H.has_class("price_chart"))
    style = F.regexp_extract(chart, r"""(?is)^<div\b[^>]*\bstyle\s*=\s*["']([^"']*)""", 1)
    hidden = F.replace(style, F.lit(" "), F.lit("")).contains("display:none")
    return (F.when(~chart.rlike(r"(?i)<table\b"), "no price table")
            .when(hidden & ~chart.rlike(r"""(?i)<td\b[^>]*\bid\s*=\s*["'][^"']*price_connect"""), "hidden price chart"))


def description_text(page: Column) -> Column:
    """Line-separated text of the first description block that is long enough."""
    def block(cls: str) -> Column:
        return X.clean_description(H.node_text(H.element(page, "div", H.has_class(cls)), "\n"), title(page))
    return F.coalesce(block("pdescription-content"), block("product-descriptions"))


def spec_rows(page: Column) -> Column:
    """``(key, value)`` rows of every specification table."""
    tables = F.filter(H.tables_of(page), lambda t: F.lower(H.node_text(F.array_join(
        H.all_outer(t, "th"), " "), " ")).rlike("specification|details"))
    return F.flatten(F.transform(tables, lambda t: F.transform(
        F.filter(F.transform(H.rows_of(t), H.cells_of), lambda c: F.size(c) >= 2),
        lambda c: F.struct(F.lower(H.node_text(F.get(c, F.lit(0)))).alias("key"),
                           H.node_text(F.get(c, F.lit(1))).alias("value")))))


def last_value(rows: Column, pattern: str, excluding: str | None = None) -> Column:
    fits = lambda r: r["key"].rlike(pattern) & (
        ~r["key"].rlike(excluding) if excluding else F.lit(True))
    return F.try_element_at(F.filter(rows, fits), F.lit(-1))["value"]


def material(page: Column, rows: Column) -> Column:
    """Specification table, else the description's own line, else a known word."""
    block = H.node_text(H.element(page, "div", H.has_class("pdescription-content")), "\n")
    return F.coalesce(last_value(rows, "material"), X.labelled_line(block, "Material", False),
                      X.material_word(H.node_text(page, "\n")))


def size(page: Column, rows: Column) -> Column:
    return F.coalesce(last_value(rows, "size|dimension", "material"), X.dimension_text(H.node_text(page, "\n")))


def money_in(text: Column, pattern: str = r"\$?\s*([\d.]+)") -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), pattern, 1).try_cast("double")


def base_tiers(page: Column) -> Column:
    """The price table's tiers, else the cells named after their quantity; one tier
    per quantity, the last price winning."""
    def aligned(b: Column) -> Column:
        pairs = F.arrays_zip(F.slice(b["head"], F.lit(2), F.greatest(F.size(b["head"]), F.lit(1))).alias("h"),
                             F.slice(b["prices"], F.lit(2), F.greatest(F.size(b["prices"]), F.lit(1))).alias("p"))
        return F.transform(pairs, lambda z: F.struct(
            F.regexp_extract(F.replace(H.node_text(z["h"]), F.lit(","), F.lit("")), r"^(\d+)", 1)
             .try_cast("bigint").alias("quantity"),
            money_in(H.node_text(z["p"])).alias("unit_price")))

    def from_table(rows: Column) -> Column:
        return let(F.struct(H.cells_of(F.get(rows, F.lit(0))).alias("head"),
                            H.cells_of(F.get(rows, F.lit(1))).alias("prices")), aligned)

    def named() -> Column:
        cells = H.all_outer(page, "td", r"""\bid\s*=\s*["']price_connect_\d+["']""")
        return F.transform(cells, lambda c: F.struct(
            F.regexp_extract(H.attribute(c, "id"), r"^price_connect_(\d+)$", 1).try_cast("bigint").alias("quantity"),
            money_in(H.node_text(c)).alias("unit_price")))

    def whole(entries: Column) -> Column:
        return F.coalesce(F.filter(entries, lambda e: e["quantity"].isNotNull() & e["unit_price"].isNotNull()).cast(_PRICE),
                          F.array().cast(_PRICE))

    listed = whole(let(H.rows_of(H.element(page, "table", H.has_id("tblPrice"))), from_table))
    chosen = let(listed, lambda es: F.when(F.size(es) > 0, es).otherwise(whole(named())))
    return tr.last_price_wins(chosen)


def price_table(table: Column, shape: Column) -> Column:
    """One price table as ``(shape, size, quantity, unit_price)``.

    A cell's quantity comes from its id, or from the header where no cell of the row
    has such an id. Single-piece placeholders and impossible prices are left out.
    """
    def parse(rows: Column) -> Column:
        header = F.transform(H.cells_of(F.get(rows, F.lit(0))), lambda c, i: F.when(
            i > 0, F.regexp_extract(H.node_text(c), r"^(\d+)", 1).try_cast("bigint")))
        body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))),
                        lambda r: r.rlike("(?i)^<tr\\b[^>]*" + H.has_class("price_chart_size_row")))
        return let(header, lambda head: F.flatten(F.transform(
            F.transform(body, H.cells_of), lambda cells: _row_tiers(cells, head, shape))))

    return F.coalesce(let(H.rows_of(table), parse), F.array().cast(_SHAPED)).cast(_SHAPED)


def _row_tiers(cells: Column, header: Column, shape: Column) -> Column:
    label = H.node_text(F.get(cells, F.lit(0)))
    read = F.filter(F.transform(cells, lambda c, i: F.struct(
        i.alias("i"),
        F.regexp_extract(F.coalesce(H.attribute(c, "id"), F.lit("")), r"^price_connect_(?:\d+_)?(\d+)$", 1)
         .try_cast("bigint").alias("by_id"),
        F.regexp_extract(H.node_text(c), r"\$?(\d+\.?\d*)", 1).try_cast("double").alias("price"))),
        lambda d: d["i"] > 0)

    def tiers(b: Column) -> Column:
        shown = F.when(F.lower(b["label"]).isin(fixed.NON_SIZE_LABELS), "Standard").otherwise(b["label"])
        listed = F.transform(b["data"], lambda d: F.struct(
            shape.alias("shape"), shown.alias("size"),
            F.when(b["named"], d["by_id"]).otherwise(F.get(header, d["i"])).alias("quantity"),
            d["price"].alias("unit_price")))
        good = F.filter(listed, lambda e: F.coalesce(sane_tier(e), F.lit(False)) & (b["label"] != ""))
        return good.cast(_SHAPED)

    return let(read, lambda data: let(F.struct(
        data.alias("data"), label.alias("label"),
        F.exists(data, lambda d: d["by_id"].isNotNull()).alias("named")), tiers))


def shape_prices(page: Column) -> Column:
    """Prices of a page whose tables sit behind shape tabs, or lie flat in the chart,
    or anywhere on the page where there is no chart."""
    default = F.lit("Default")
    none = F.array().cast(_SHAPED)

    def tabs(b: Column) -> Column:
        return F.flatten(F.transform(b["links"], lambda a: price_table(
            F.get(F.filter(b["panes"], lambda p: p["pane"] == a["pane"]), F.lit(0))["table"], a["shape"])))

    def in_chart(chart: Column) -> Column:
        navs = F.filter(H.all_outer(chart, "nav"), lambda n: n.rlike(r"""(?i)href\s*=\s*["']#nav-price-"""))
        links = F.transform(
            H.all_outer(F.get(navs, F.lit(0)), "a", r"""\bhref\s*=\s*["']#nav-price-"""),
            lambda a: F.struct(H.node_text(a).alias("shape"), F.regexp_extract(H.attribute(a, "href"), "(?s)^#(.*)$", 1).alias("pane")))
        panes = F.transform(
            F.split(H.element(chart, "div", H.has_id("nav-tabContent")), r"""(?i)(?=<div\b[^>]*\bid\s*=\s*["']nav-price-)"""),
            lambda p: F.struct(H.attribute(p, "id").alias("pane"), F.get(H.tables_of(p), F.lit(0)).alias("table")))
        flat = F.flatten(F.transform(H.tables_of(chart), lambda t: price_table(t, default)))
        tabbed = lambda b: (F.size(b["links"]) > 0) & F.exists(b["panes"], lambda p: p["pane"].isNotNull())
        return let(F.struct(links.alias("links"), panes.alias("panes")),
                   lambda b: F.coalesce(F.when(tabbed(b), tabs(b)).otherwise(flat), none))

    def anywhere() -> Column:
        priced = F.filter(H.tables_of(page), lambda t: H.node_text(t).contains("$"))
        read = F.filter(F.transform(priced, lambda t: price_table(t, default)), lambda r: F.size(r) > 0)
        return F.coalesce(F.get(read, F.lit(0)), none)

    structured = let(H.element(page, "div", H.has_class("price_chart")), in_chart)
    return let(structured, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(anywhere()))


def options(page: Column, image_host: str | None = None) -> Column:
    """Options in document order with the step heading they stand under.

    The page is cut in front of every step heading, so each piece carries its own
    heading and nothing has to be remembered across rows.
    """
    # Possessive: a greedy group would take one stack frame for each blank.
    pieces = F.split(page, rf"(?i)(?=<h[2-5]\b[^>]*+>(?:\s++|<[^>]*+>)*+{_STEP})")
    marks = r"\bdata-product-option-value-id\b"

    opening = lambda t: F.regexp_extract(t, r"(?is)^(<[^>]*>)", 1)
    picture = lambda t: F.regexp_extract(t, r"""(?is)<img\b[^>]*?\s(?:data-src|src)\s*=\s*["']([^"']*)""", 1)

    def swatch(t: Column) -> Column:
        if not image_host:
            return F.lit(None).cast("string")
        named = F.concat(F.lit(f"https://{image_host}/fit-in/400x400/"), H.attribute(t, "data-img"))
        return let(picture(t), lambda src: F.when(src.contains(image_host), src).otherwise(named))

    def of(piece: Column) -> Column:
        step = F.when(piece.rlike(r"(?i)^<h[2-5]\b"), H.node_text(F.regexp_extract(
            piece, r"(?is)^<h[2-5]\b[^>]*>(.*?)</h[2-5]\s*>", 1), " ")).otherwise("")
        heading = let(step, lambda s: F.struct(X.option_group(s).alias("group"), s.alias("step")))
        found = H.elements(piece, marks)
        hidden = lambda t: let(opening(t), lambda tag: tag.rlike(
            "(?i)" + H.has_class("form-control")) & tag.rlike("(?i)" + H.has_class("quantities")))
        visible = F.filter(found, lambda t: ~hidden(t))

        def entries(h: Column) -> Column:
            return F.transform(visible, lambda t: F.struct(
                h["group"].alias("group"),
                X.strip(F.coalesce(H.attribute(t, "data-original-option-value-name"), H.node_text(t, " "))).alias("label"),
                F.coalesce(H.attribute(t, "data-product-option-value-id"), F.lit("")).alias("option_value_id"),
                H.attribute(t, "data-option-id").alias("option_id"),
                X.money(F.coalesce(H.attribute(t, "data-price"), F.lit("0"))).alias("price_modifier"),
                swatch(t).alias("swatch_image_url"), h["step"].alias("step_label")))

        return F.filter(let(heading, entries), lambda r: r["label"] != "")

    holding = F.filter(pieces, lambda p: p.contains("data-product-option-value-id"))
    return F.flatten(F.transform(holding, of))


def options_by_group(listed: Column) -> Column:
    """``map<group, array<option>>`` with every group present; the first of equal
    (option id, label) pairs inside a group stays."""
    identity = lambda o: F.concat(o["option_value_id"], F.lit(":"), o["label"])
    shown = lambda o: F.struct(*[o[c].alias(c) for c in (
        "label", "option_value_id", "option_id", "price_modifier", "swatch_image_url", "step_label")])

    def group(every: Column, name_: str) -> Column:
        def first(b: Column) -> Column:
            kept = F.filter(b["mine"], lambda o, i: F.array_position(b["keys"], identity(o)) == i + 1)
            return F.transform(kept, shown)
        return let(F.filter(every, lambda o: o["group"] == name_), lambda mine: let(
            F.struct(mine.alias("mine"), F.transform(mine, identity).alias("keys")), first))
    return let(listed, lambda every: F.create_map(
        *[x for g in fixed.OPTION_GROUPS for x in (F.lit(g), group(every, g))]))


def sku(html: Column, page: Column) -> Column:
    """``struct<sku, database_tag, sku_source>`` from the first place that has one."""
    tag = F.coalesce(X.blank_to_null(F.regexp_extract(html, r'database_tag"\s*:\s*"([^"]+)"', 1)),
                     X.blank_to_null(F.regexp_extract(html, r'data-product-id="(\d+)"', 1)))
    inline = X.blank_to_null(X.strip(F.regexp_extract(html, r'"sku"\s*:\s*"([^"]+)"', 1)))
    # A plain substring test spares the tag expressions on pages without the marker.
    prop = F.when(page.contains("itemprop"), F.get(F.regexp_extract_all(page, F.lit(
        r"""(?is)(<(\w+)\b(?=[^>]*\bitemprop\s*=\s*["']sku["'])[^>]*>(?:[^<]*</\2\s*>)?)"""), F.lit(1)), F.lit(0)))
    itemprop = let(prop, lambda t: X.blank_to_null(X.strip(F.coalesce(H.attribute(t, "content"), H.node_text(t)))))
    data = F.when(page.contains("data-sku"), X.blank_to_null(X.strip(F.regexp_extract(
        page, r"""(?is)<\w+\b[^>]*\sdata-sku\s*=\s*["']([^"']*)""", 1))))
    in_ld = F.get(F.filter(F.transform(json_ld(html), lambda o: F.when(
        F.try_variant_get(o, "$['@type']", "string") == "Product",
        X.blank_to_null(X.strip(F.try_variant_get(o, "$.sku", "string"))))), lambda x: x.isNotNull()), F.lit(0))
    places = F.struct(inline.alias("json_sku"), itemprop.alias("itemprop_sku"), data.alias("data_sku"),
                      in_ld.alias("ldjson_sku"), F.concat(F.lit("SKU"), tag).alias("db_tag"), tag.alias("tag"))
    labels = ["json_sku", "itemprop_sku", "data_sku", "ldjson_sku", "db_tag"]

    def first(p: Column) -> Column:
        source = F
        for label in labels:
            source = source.when(p[label].isNotNull(), F.lit(label))
        return F.struct(F.coalesce(*[p[label] for label in labels]).alias("sku"), p["tag"].alias("database_tag"),
                        source.otherwise("none").alias("sku_source"))

    return let(places, first)


def json_ld(html: Column) -> Column:
    """The objects of all JSON-LD scripts, lists taken apart; scripts that are no JSON are left out."""
    texts = F.regexp_extract_all(html, F.lit(
        r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1))
    objects = F.flatten(F.transform(texts, lambda t: F.coalesce(
        F.try_variant_get(F.try_parse_json(t), "$", "array<variant>"), F.array(F.try_parse_json(t)))))
    return F.when(html.contains("ld+json"), F.filter(objects, lambda o: o.isNotNull()))


def script_images(html: Column) -> Column:
    """Images of the page's inline data array, media files left out."""
    block = F.regexp_extract(html, r'(?s)custom_ads_data\s*=\s*\{[^}]*"images"\s*:\s*\[(.*?)\]', 1)
    found = F.transform(F.regexp_extract_all(block, F.lit(r'"(https?:[^"]+)"'), F.lit(1)),
                        lambda u: F.replace(u, F.lit("\\/"), F.lit("/")))
    return F.array_distinct(F.filter(found, lambda u: U.image_allowed(u, fixed.MEDIA_DENY)))


def lazy_images(page: Column, host: str, needs: str = "", deny: list[str] | None = None) -> Column:
    found = F.transform(H.all_tags(page, "img", r"\bdata-src\s*="), lambda t: F.coalesce(
        H.attribute(t, "data-src"), F.lit("")))
    return F.array_distinct(F.filter(found, lambda u: u.contains(host) & u.contains(needs) & U.image_allowed(u, deny)))


def cdn_images(html: Column, host: str, needs: str = "", deny: list[str] | None = None) -> Column:
    pattern = (r"(?i)(https?://" + host.replace(".", r"\.") + r"/fit-in/\d+x\d+/" + needs
               + r"""[^\s"'<>]+\.(?:webp|jpg|jpeg|png))""")
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
                                     lambda u: U.image_allowed(u, deny)))


def first_list(*lists: Column) -> Column:
    """The first list with entries, else an empty one."""
    out = F
    for one in lists:
        out = out.when(F.size(one) > 0, one)
    return out.otherwise(F.array().cast("array<string>"))


def imprint_styles(page: Column) -> Column:
    """Texts of form options that name an imprint technique, first occurrences."""
    texts = F.transform(H.all_outer(page, "option", r"\bdata-option-value-id\b"), lambda o: H.node_text(o))
    return F.array_distinct(F.filter(texts, lambda t: (t != "") & ~F.lower(t).isin(fixed.IMPRINT_PLACEHOLDERS)
                                     & X.any_phrase(t, fixed.IMPRINT_WORDS)))


def embedded_props(html: Column) -> Column:
    """The editor container's JSON text (kept as text: its key order matters)."""
    raw = F.regexp_extract(html, r"""(?is)<div\b(?=[^>]*\bid\s*=\s*["']product-editor-container["'])[^>]*?"""
                                 r"""\sdata-symfony--ux-react--react-props-value\s*=\s*"([^"]*)\"""", 1)
    return H.unescape(X.blank_to_null(raw))


def embedded_tiers(props: Column, size_: Column) -> Column:
    """Tiers of the size's price list (the first list where that size has none), in
    the order of the listed quantities."""
    def pick(b: Column) -> Column:
        wanted = F.concat(F.lit("pricing_"), F.lower(size_))
        chosen = F.coalesce(F.try_element_at(b["lists"], wanted), F.get(F.map_values(b["lists"]), F.lit(0)))["pricing"]
        hits = let(chosen, lambda prices: F.transform(
            b["quantities"], lambda q: F.try_element_at(prices, F.concat(F.lit("qty_"), q))))
        return F.transform(F.filter(hits, lambda h: h.isNotNull()), lambda h: F.struct(
            h["qty"]["from"].alias("quantity"), h["usd"].try_cast("double").alias("price")))

    def read(v: Column) -> Column:
        lists = F.from_json(F.get_json_object(v, "$.product.pricing.variants"),
                            "map<string,struct<pricing:map<string,struct<qty:struct<`from`:bigint>,usd:string>>>>")
        quantities = F.from_json(F.get_json_object(v, "$.product.pricing.quantities"), "array<string>")
        return let(F.struct(lists.alias("lists"), quantities.alias("quantities")), pick)

    return let(props, read)


def embedded_images(props: Column, size_: Column, html: Column) -> Column:
    """Product images, else the image of the variant of that size, else of the first
    variant, else the JSON-LD image."""
    def choose(b: Column) -> Column:
        named = F.get(F.filter(b["variants"], lambda v: F.lower(v["name"]) == F.lower(size_)), F.lit(0))["image"]
        first = F.get(b["variants"], F.lit(0))["image"]
        single = F.coalesce(X.blank_to_null(named), X.blank_to_null(first), b["ld"])
        return F.when(F.size(b["images"]) > 0, b["images"]).when(single.isNotNull(), F.array(single)).otherwise(
            F.array().cast("array<string>"))

    return let(F.try_parse_json(props), lambda v: let(F.struct(
        F.try_variant_get(v, "$.product.productImages", "array<string>").alias("images"),
        F.try_variant_get(v, "$.product.variants", "array<struct<name:string,image:string>>").alias("variants"),
        F.get(F.filter(F.transform(json_ld(html), lambda o: F.try_variant_get(o, "$.image", "string")), lambda x: x.isNotNull()),
              F.lit(0)).alias("ld")), choose))
