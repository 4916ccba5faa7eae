"""Extraction jobs over a stored page corpus.

A job takes pages ``(url, html)`` (other columns are ignored, ``lastmod``,
``product_subtype`` and ``discovery_source`` are used where present) and returns
``(url, outcome, reason, product)`` with ``product`` as a struct. Jobs register
themselves with their site's data, which also fills the registry table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfdelta.functions import fixed, html as H, urls as U
from shelfdelta.functions import text as X
from shelfdelta.operators import combinations as C, page_parts as G, tiers as tr, variants as V
from shelfdelta.schemas import REGISTRY

Job = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Site:
    site_id: str
    name: str
    base_url: str
    job: Job
    tags: list[str] = field(default_factory=list)
    description: str = ""
    version: str = "1.0.0"


SITES: dict[str, Site] = {}


def extraction(site_id: str, name: str, base_url: str, tags: list[str] | None = None,
               **about: str) -> Callable[[Job], Job]:
    """Register a job under a site id."""
    def wrap(job: Job) -> Job:
        SITES[site_id] = Site(site_id, name, base_url, job, tags or [], **about)
        return job
    return wrap


def declared_registry(spark: SparkSession, at) -> DataFrame:
    """The registered sites as registry rows."""
    rows = [(s.site_id, s.name, s.base_url, "active",
             (s.description, s.version, "", s.tags, [], 60, False, 30), at, None) for s in SITES.values()]
    return spark.createDataFrame(rows, REGISTRY)


def run_site(pages: DataFrame, site_id: str) -> DataFrame:
    return SITES[site_id].job(pages)


def products_of(extracted: DataFrame) -> DataFrame:
    """The products alone, one column per field."""
    return extracted.filter(F.col("outcome") == "scraped").select("product.*")


def _optional(pages: DataFrame, name: str, default: str | None = None) -> Column:
    return F.col(name) if name in pages.columns else F.lit(default).cast("string")


def _outcome(rows: DataFrame, problem: Column, product: Column, unreadable: Column | None = None) -> DataFrame:
    """``failed`` where there is no page or it cannot be read, ``skipped`` where it is no product."""
    bad = F.col("_problem")
    broken = F.when(F.col("html").isNull(), "no page")
    if unreadable is not None:
        broken = F.coalesce(broken, unreadable)
    judged = rows.withColumn("_broken", broken).withColumn("_problem", F.coalesce("_broken", problem))
    return judged.select(
        "url", F.when(bad.isNull(), "scraped").when(F.col("_broken").isNotNull(), "failed").otherwise("skipped").alias("outcome"),
        bad.alias("reason"), F.when(bad.isNull(), product).alias("product"))


def _last_segment() -> Column:
    return X.or_blank(F.try_element_at(U.segments(F.col("url")), F.lit(-1)))


def _option_step_parts(pages: DataFrame, image_host: str) -> DataFrame:
    """Axes, prices, numbers and images of option-step pages."""
    page = F.col("_page")
    # Each intermediate is its own projection, so it is computed once per page.
    rows = pages.select(
        "url", "html", _optional(pages, "lastmod").alias("lastmod"),
        _optional(pages, "product_subtype", "standard").alias("product_subtype"),
        _optional(pages, "discovery_source").alias("discovery_source"), H.markup(F.col("html")).alias("_page"))
    rows = rows.withColumn("_specs", G.spec_rows(page)).withColumn(
        "_options", G.options_by_group(G.options(page, image_host))).withColumn(
        "_base", G.base_tiers(page)).withColumn("_sku", G.sku(F.col("html"), page)).withColumn(
        "_images", G.first_list(G.script_images(F.col("html")), G.lazy_images(page, image_host),
                                G.cdn_images(F.col("html"), image_host)))
    return rows.withColumn("_base", tr.flagged(F.col("_base")))


def option_step_variants(pages: DataFrame, image_host: str = "static.customnapkinsnow.com", cap: int | None = None) -> DataFrame:
    """The variants of option-step pages as rows (url, ordinal, variant), however many a page has."""
    rows = _option_step_parts(pages, image_host).filter(F.col("html").isNotNull() & G.valid_title(F.col("_page")))
    return C.variant_rows(rows, ["url"], F.col("_options"), F.col("_base"), _last_segment(), F.col("_sku.database_tag"), cap)


@extraction("customnapkinsnow", "Option-step pages", "https://www.customnapkinsnow.com", ["html", "variants"])
def option_step_pages(pages: DataFrame, image_host: str = "static.customnapkinsnow.com", cap: int | None = None) -> DataFrame:
    """Pages with step headings: option axes, a price table, a variant matrix (whole unless ``cap`` is given)."""
    page = F.col("_page")
    rows = _option_step_parts(pages, image_host)
    rows = rows.withColumn("_variants", V.build_variants(
        F.col("_options"), F.col("_base"), _last_segment(), F.col("_sku.database_tag"), cap))
    options, base, variants = F.col("_options"), F.col("_base"), F.col("_variants")
    colours = V.colours_of(options)
    labels = F.filter(F.transform(colours, lambda c: c["label"]), lambda x: x != "")
    product = F.struct(
        F.lit("customnapkinsnow").alias("source"), F.col("url").alias("product_url"),
        F.lit(2).alias("schema_version"), "lastmod", "product_subtype", "discovery_source",
        G.name(page, [" - CustomNapkinsNow.Com", " - Custom Napkins Now"]).alias("name"),
        U.segment_title(F.col("url"), 1).alias("category"), U.segment_title(F.col("url"), 2).alias("subcategory"),
        G.meta_description(page).alias("meta_description"), G.description_text(page).alias("description"),
        G.material(page, F.col("_specs")).alias("material"), G.size(page, F.col("_specs")).alias("size"),
        F.col("_sku.sku").alias("product_sku"), F.col("_sku.database_tag").alias("database_tag"),
        F.col("_sku.sku_source").alias("sku_source"),
        options.alias("options"),
        F.filter(F.array(*[F.lit(g) for g in fixed.OPTION_GROUPS]),
                 lambda g: F.size(F.try_element_at(options, g)) > 0).alias("option_groups_detected"),
        colours.alias("colors"),
        F.when(F.size(labels) > 0, labels).otherwise(_legacy_colours(page)).alias("available_colors"),
        base.alias("base_tiers"), variants.alias("variants"),
        tr.flat_pricing(variants).alias("pricing"), tr.print_methods(variants).alias("print_methods"),
        tr.min_order(variants, base).alias("min_order_qty"),
        X.main_image(F.col("_images")).alias("main_image"), X.gallery(F.col("_images")).alias("gallery_images"))
    return _outcome(rows, F.when(~G.valid_title(page), "no title"), product)


def _legacy_colours(page: Column) -> Column:
    """The colour row of a specification table, for pages without colour steps."""
    rows = F.flatten(F.transform(H.tables_of(page), lambda t: F.filter(
        F.transform(H.rows_of(t), H.cells_of), lambda c: F.size(c) >= 2)))
    hits = F.filter(rows, lambda c: F.lower(H.node_text(F.get(c, F.lit(0)))).rlike("available color|colour"))
    return F.coalesce(X.colour_list(H.node_text(F.get(F.get(hits, F.lit(0)), F.lit(1)), "\n")),
                      F.array().cast("array<string>"))


@extraction("customcoasters", "Shape-tab pages", "https://www.customcoastersnow.com", ["html", "pricing"])
def shape_tab_pages(pages: DataFrame, image_host: str = "static.customcoastersnow.com") -> DataFrame:
    """Pages priced by shape and size, one table per shape tab."""
    page = F.col("_page")
    deny = fixed.IMAGE_DENY + fixed.IMAGE_DENY_EXTRA
    rows = pages.select("url", "html", _optional(pages, "lastmod").alias("lastmod"),
                        H.markup(F.col("html")).alias("_page"))
    rows = rows.withColumn("_prices", G.shape_prices(page)).withColumn(
        "_images", G.first_list(G.lazy_images(page, image_host, "/product_", deny),
                                G.cdn_images(F.col("html"), image_host, "product_", deny)))
    prices = F.col("_prices")
    parts = U.segments(F.col("url"))
    block = H.node_text(H.element(page, "div", H.has_class("pdescription-content")), "\n")
    sub = F.when((F.size(parts) > 2) & (F.get(parts, F.lit(2)) != "custom"),
                 U.segment_title(F.col("url"), 2)).otherwise(U.segment_title(F.col("url"), 3))
    product = F.struct(
        F.lit("customcoasters").alias("source"), F.col("url").alias("product_url"), "lastmod",
        G.name(page, [" - CustomCoastersNow.Com", " - Custom Coasters Now"]).alias("name"),
        U.segment_title(F.col("url"), 1).alias("category"), sub.alias("subcategory"),
        G.meta_description(page).alias("meta_description"), G.description_text(page).alias("description"),
        X.labelled_line(block, "Material").alias("material"),
        X.labelled_line(block, "Thickness").alias("thickness"), X.labelled_line(block, "Shapes").alias("shapes"),
        G.imprint_styles(page).alias("imprint_styles"), prices.alias("pricing"),
        F.array_min(F.transform(prices, lambda p: p["quantity"])).alias("min_order_qty"),
        F.array_sort(F.array_distinct(F.transform(prices, lambda p: p["shape"]))).alias("available_shapes"),
        X.main_image(F.col("_images")).alias("main_image"), X.gallery(F.col("_images")).alias("gallery_images"))
    return _outcome(rows, G.price_chart_problem(page), product)


@extraction("yardsignplus", "Embedded-JSON pages", "https://www.yardsignplus.com", ["json", "json-ld"])
def embedded_json_pages(pages: DataFrame) -> DataFrame:
    """Pages whose product is a JSON-LD script plus an editor container's JSON."""
    rows = pages.select("url", "html", G.json_ld(F.col("html")).alias("_ld"),
                        G.embedded_props(F.col("html")).alias("_props"), U.size_in_url(F.col("url")).alias("_size"))
    is_product = lambda o: F.try_variant_get(o, "$['@type']", "string") == "Product"
    rows = rows.withColumn("_ld", F.get(F.filter("_ld", is_product), F.lit(0))).withColumn(
        "_images", G.embedded_images(F.col("_props"), F.col("_size"), F.col("html")))
    ld = lambda path: F.try_variant_get(F.col("_ld"), path, "string")
    name = X.or_blank(ld("$.name"))
    product = F.struct(
        F.lit("yardsignplus").alias("source"), U.id_in_url(F.col("url")).alias("product_id"),
        name.alias("name"), X.or_blank(ld("$.description")).alias("description"), ld("$.brand.name").alias("brand"),
        U.segment_title(F.col("url"), 0).alias("category"), U.segment_title(F.col("url"), 2).alias("subcategory"),
        F.col("_size").alias("size"), X.main_image(F.col("_images")).alias("main_image"),
        X.gallery(F.col("_images")).alias("gallery_images"),
        G.embedded_tiers(F.col("_props"), F.col("_size")).alias("pricing"),
        F.coalesce(ld("$.offers.availability").contains("InStock"), F.lit(False)).alias("is_active"),
        F.when(F.lower(name).contains("sign"), "Corrugated Plastic (Coroplast)").alias("material"),
        F.col("url").alias("product_url"))
    problem = F.when(F.coalesce(ld("$['@type']"), F.lit("")) != "Product", "no product JSON-LD")
    broken = F.when(F.col("_props").isNotNull() & F.try_parse_json(F.col("_props")).isNull(), "unreadable editor data")
    return _outcome(rows, problem, product, F.when(problem.isNull(), broken))
