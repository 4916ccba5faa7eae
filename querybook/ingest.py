"""Ingest, discovery and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from querybook.derived import SLUG_SQL, table, ts
from shelfdelta.functions import fixed, html as H, payload as P, predicates as W, text as X, urls as U
from shelfdelta.operators import discovery as DI, page_parts as G, paging

from shelfdelta.session import staging_path
from shelfdelta.sources import envelope as E, sitemap as SM
from shelfdelta.sources.tables import Store, latest_sessions, recent_sessions

_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_MARKUP = (r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')")


def _unescape_sql(c: str) -> str:
    for entity, char in H.ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def _canonical_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '(?s)[?#].*$', '')"
    return (f"CASE WHEN {bare} LIKE '%/' AND length({bare}) - length(replace({bare}, '/', '')) > 3 "
            f"THEN rtrim({bare}, '/') ELSE {bare} END")


_PATH_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PARTS_SQL = f"list_filter(string_split({_PATH_SQL}, '/'), lambda s: s <> '')"


def _initcap_sql(c: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({c}, '-', ' '), ' '), "
            "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")


@query(f"""WITH p AS (SELECT page_id, url, {_MARKUP} AS m, {_PARTS_SQL} AS parts FROM pages)
SELECT page_id, {_STRIP.format(c=_unescape_sql("regexp_extract(m, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} AS name,
 {_initcap_sql('parts[1]')} AS category, {_initcap_sql('parts[2]')} AS subcategory,
 length({_STRIP.format(c=_unescape_sql("regexp_extract(m, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))}) >= 3 AS valid
FROM p""")
def page_basics(spark, sf) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", "url", H.markup(F.col("html")).alias("m"))
    page = F.col("m")
    return rows.select("page_id", G.name(page, []).alias("name"), U.segment_title(F.col("url"), 0).alias("category"),
                       U.segment_title(F.col("url"), 1).alias("subcategory"), G.valid_title(page).alias("valid"))


@query(f"""WITH h AS (SELECT page_id, url AS base, unnest(regexp_extract_all({_MARKUP},
  '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href,
 generate_subscripts(regexp_extract_all({_MARKUP}, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1), 1) AS i FROM pages),
r AS (SELECT page_id, i, CASE WHEN href LIKE '/%' THEN regexp_extract(base, '^([a-zA-Z]+://[^/?#]*)', 1) || href
  ELSE href END AS u FROM h)
SELECT page_id AS page, CAST(i - 1 AS INT) AS pos, {_canonical_sql('u')} AS url FROM r""")
def page_links(spark, sf) -> DataFrame:
    return DI.links(table(spark, sf, "pages")).select("page", "pos", "url")


@query(f"""SELECT page_id, {_canonical_sql('url')} AS canonical, len({_PARTS_SQL}) = 2 AND {_PARTS_SQL}[1] = 'en' AS is_root,
 coalesce(regexp_extract(url, '/([A-Z]+[0-9]+|CUSTOM)(?:\\?|$)', 1), '') AS code,
 CASE WHEN url LIKE '%/es/%' THEN 'deal' ELSE 'standard' END AS subtype FROM pages""")
def url_rules(spark, sf) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.canonical(url).alias("canonical"),
        U.is_category_root(url, U.origin(url), root="en").alias("is_root"),
        X.or_blank(U.id_in_url(url)).alias("code"), U.subtype(url, ["/es/"]).alias("subtype"))


# URLs found three ways: the sitemap lists parts, the homepage the items of large
# orders, category pages every ordered part.
_FOUND = f"""slugged AS (SELECT p_partkey, 'https://shop.example.com/product/' || CASE WHEN p_size > 45 THEN 'deal/' ELSE '' END
   || lower(p_type) || '/' || {SLUG_SQL} AS url, p_size FROM part),
found AS (SELECT url, 'sitemap' AS source, CAST(p_partkey AS BIGINT) AS place FROM slugged WHERE p_size < 20
 UNION ALL SELECT url, 'homepage', l_orderkey FROM lineitem JOIN slugged ON l_partkey = p_partkey WHERE l_quantity > 49
 UNION ALL SELECT url, 'category', l_orderkey FROM lineitem JOIN slugged ON l_partkey = p_partkey)"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE source WHEN 'sitemap' THEN 1
  WHEN 'homepage' THEN 2 ELSE 3 END, place) AS k FROM found)"""


def _found(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(
        F.lit("https://shop.example.com/product/"), F.when(F.col("p_size") > 45, "deal/").otherwise(""),
        F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"),
        F.col("p_partkey").cast("string")).alias("url"))
    sold = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    one = lambda df, source, place: df.select("url", F.lit(source).alias("source"), place.alias("place"))
    listed = one(parts.filter("p_size < 20"), "sitemap", F.col("p_partkey"))
    # One pass over the items: the large ones count for the homepage as well.
    origin = F.explode(F.when(F.col("l_quantity") > 49, F.array(F.lit("homepage"), F.lit("category"))).otherwise(
        F.array(F.lit("category"))))
    crawled = sold.select("url", origin.alias("source"), F.col("l_orderkey").alias("place"))
    return listed.unionByName(crawled)


@query(f"""WITH {_FOUND}, {_RANKED} SELECT url, source, place,
 CASE WHEN url LIKE '%/deal/%' THEN 'deal' ELSE 'standard' END AS product_subtype FROM ranked WHERE k = 1""")
def link_precedence_union(spark, sf) -> DataFrame:
    return DI.by_precedence(_found(spark, sf)).select("url", "source", "place", "product_subtype")


@query(f"""WITH {_FOUND}, {_RANKED} SELECT source, CASE WHEN url LIKE '%/deal/%' THEN 'deal' ELSE 'standard' END
 AS product_subtype, count(*) AS n FROM ranked WHERE k = 1 GROUP BY 1, 2""")
def discovery_counters(spark, sf) -> DataFrame:
    return DI.discovery_counters(DI.by_precedence(_found(spark, sf)))


# Stored documents hold the date of an item's first shipment, the sitemap the last.
_DATES = """d AS (SELECT l_partkey, l_linenumber, min(l_shipdate) AS a, max(l_shipdate) AS b, max(l_returnflag) AS flag
  FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_DATES} SELECT 'u' || l_partkey || '-' || l_linenumber AS url,
 CASE WHEN flag <> 'A' AND l_linenumber <> 7 AND strftime(a, '%Y') = strftime(b, '%Y') THEN 'skip' ELSE 'fetch' END AS action,
 CASE WHEN flag <> 'A' AND l_linenumber <> 7 AND strftime(a, '%Y') = strftime(b, '%Y')
  THEN '{{"name":"' || l_partkey || '"}}' END AS reused FROM d""")
def lastmod_skip(spark, sf) -> DataFrame:
    dates = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.max("l_returnflag").alias("flag"))
    url = F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    found = dates.select(url.alias("url"), F.when(F.col("flag") != "A", F.date_format("b", " yyyy ")).alias("lastmod"))
    stored = dates.select(
        url.alias("product_url"), F.when(F.col("l_linenumber") == 7, 1).otherwise(2).alias("schema_version"),
        F.date_format("a", "yyyy").alias("lastmod"),
        P.of_columns({"name": F.col("l_partkey").cast("string"), "data_hash": F.lit("x")}).alias("payload"))
    split = DI.lastmod_split(found, stored)
    return split.select("url", "action", F.when(F.col("reused").isNotNull(), P.canonical_text(F.col("reused"))).alias("reused"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '{"k":' || json_extract(props, '$.k') || '}' AS body,
 left(sha256('{"k":' || json_extract(props, '$.k') || '}'), 32) AS hash, 'none' AS missing FROM events""")
def props_json_fields(spark, sf) -> DataFrame:
    body = P.parse(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", body.alias("b"))
    return rows.select("event_id", P.text_value(F.col("b"), "k").alias("k"), P.canonical_text(F.col("b")).alias("body"),
                       P.content_hash(F.col("b")).alias("hash"),
                       F.coalesce(P.text_value(F.col("b"), "absent"), F.lit("none")).alias("missing"))


# Envelopes in the shapes crawlers send, one per document, by language.
def _envelopes(spark, sf) -> DataFrame:
    one = F.struct(F.lit("p1").alias("name"), F.col("doc_id").alias("ref"))
    two = F.struct(F.lit("p2").alias("name"), F.col("n_chars").alias("ref"))
    items = F.array(one, two)
    js = F.to_json
    data = (F.when(F.col("lang") == "en", js(F.struct(items.alias("products"))))
            .when(F.col("lang") == "fr", js(F.struct(F.array().cast("array<string>").alias("products"),
                                                     F.array(one).alias("suppliers"))))
            .when(F.col("lang") == "de", js(one))
            .otherwise(js(items)))
    return table(spark, sf, "documents").select("doc_id", "lang", data.alias("data"))


_ENVELOPES = """e AS (SELECT doc_id, lang, n_chars FROM documents),
both_ AS (SELECT doc_id, 0 AS pos, 'p1' AS name, doc_id AS ref FROM e WHERE lang IN ('en', 'es')
 UNION ALL SELECT doc_id, 1, 'p2', n_chars FROM e WHERE lang IN ('en', 'es')
 UNION ALL SELECT doc_id, 0, 'p1', doc_id FROM e WHERE lang = 'de')"""


@query(f"""WITH {_ENVELOPES} SELECT 'storage' AS rule, doc_id, CAST(pos AS INT) AS pos, name, ref FROM both_
 UNION ALL SELECT 'export', doc_id, CAST(pos AS INT), name, ref FROM both_
 UNION ALL SELECT 'export', doc_id, CAST(0 AS INT), 'p1', doc_id FROM e WHERE lang = 'fr'""")
def envelope_products(spark, sf) -> DataFrame:
    """An empty products list ends the storage rule; the export rule goes on to suppliers."""
    rows = _envelopes(spark, sf)
    def of(rule, products):
        out = E.explode_products(rows, products)
        p = F.from_json("doc", "name string, ref bigint")
        return out.select(F.lit(rule).alias("rule"), "doc_id", "pos", p["name"].alias("name"), p["ref"].alias("ref"))
    return of("storage", E.storage_products(F.col("data"))).union(of("export", E.export_products(F.col("data"))))


@query("""SELECT p_partkey AS page, CAST(0 AS INT) AS pos, 'id-' || p_partkey AS id, false AS failed FROM part WHERE p_size <> 50
 UNION ALL SELECT p_partkey, CAST(1 AS INT), p_brand, false FROM part WHERE p_size <> 50
 UNION ALL SELECT p_partkey, NULL, NULL, true FROM part WHERE p_size = 50""")
def paged_payload_merge(spark, sf) -> DataFrame:
    """API pages as JSON text, some cut off mid-way: items of the good ones, the bad ones named."""
    item = lambda c: F.struct(c.alias("id"))
    body = F.to_json(F.struct(F.lit(2).alias("total"), F.array(
        item(F.concat(F.lit("id-"), F.col("p_partkey").cast("string"))), item(F.col("p_brand"))).alias("data")))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.when(
        F.col("p_size") == 50, F.left(body, F.lit(20))).otherwise(body).alias("body"))
    good = E.page_items(pages).select("page", "pos", F.from_json("doc", "id string")["id"].alias("id"),
                                      F.lit(False).alias("failed"))
    bad = E.failed_pages(pages).select("page", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("id"),
                                       F.lit(True).alias("failed"))
    return good.union(bad)


# A sitemap file per page: the page, a product URL, the product again, a category root.
def _sitemaps(spark, sf) -> DataFrame:
    entry = lambda loc, rest: F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc>"), F.lit(rest), F.lit("</url>"))
    product = F.concat(F.lit("https://shop.example.com/product/cups/p"), F.col("page_id").cast("string"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        entry(F.replace("url", F.lit("&"), F.lit("&amp;")), "<lastmod>2024-01-05</lastmod>"),
        entry(F.concat(product, F.lit("/?ref=1")), "<lastmod>2024-01-06</lastmod><priority>0.5</priority>"),
        entry(product, "<priority>high</priority>"),
        entry(F.lit("https://shop.example.com/product/cups/all"), "<priority>1.0</priority>"),
        F.lit("<url><lastmod>2024-01-07</lastmod></url></urlset>"))
    return table(spark, sf, "pages").select(
        F.concat(F.lit("https://shop.example.com/s"), F.col("page_id").cast("string"), F.lit(".xml")).alias("url"),
        body.alias("body"))


@query(f"""SELECT 'https://shop.example.com/s' || page_id || '.xml' AS sitemap, url, '2024-01-05' AS lastmod, 0.8 AS priority,
  false AS product FROM pages
 UNION ALL SELECT 'https://shop.example.com/s' || page_id || '.xml', 'https://shop.example.com/product/cups/p' || page_id
  || '/?ref=1', '2024-01-06', 0.5, true FROM pages
 UNION ALL SELECT 'https://shop.example.com/s' || page_id || '.xml', 'https://shop.example.com/product/cups/p' || page_id,
  NULL, 0.8, true FROM pages
 UNION ALL SELECT 'https://shop.example.com/s' || page_id || '.xml', 'https://shop.example.com/product/cups/all', NULL, 1.0,
  false FROM pages""".replace("0.8", "CAST(0.8 AS DOUBLE)").replace("0.5,", "CAST(0.5 AS DOUBLE),").replace(
    "1.0,", "CAST(1.0 AS DOUBLE),"))
def sitemap_scan(spark, sf) -> DataFrame:
    found = SM.entries(_sitemaps(spark, sf))
    product = U.is_product(U.canonical(F.col("url")), "https://shop.example.com") & (F.col("priority") < 1.0)
    return found.select("sitemap", "url", "lastmod", "priority", product.alias("product"))


@query("""SELECT 'https://shop.example.com/product/cups/p' || page_id AS url, '2024-01-06' AS lastmod FROM pages""")
def sitemap_products(spark, sf) -> DataFrame:
    """Product entries after canonicalisation, the first of each URL."""
    return SM.product_entries(SM.entries(_sitemaps(spark, sf)), "https://shop.example.com").select("url", "lastmod")


# Every supplier is a site whose root index leads two levels down.
@query("""WITH s AS (SELECT 'https://s' || s_suppkey || '.example/' AS b FROM supplier)
SELECT b || 'sitemap.xml' AS url, 0 AS depth, true AS is_index FROM s
UNION ALL SELECT b || 'a.xml', 1, true FROM s UNION ALL SELECT b || 'b.xml', 1, false FROM s
UNION ALL SELECT b || 'c.xml', 2, false FROM s""")
def sitemap_index_walk(spark, sf) -> DataFrame:
    base = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example/"))
    locs = lambda names: F.concat(F.lit("<sitemapindex>"), *[F.concat(
        F.lit("<sitemap><loc>"), base, F.lit(f"{n}</loc></sitemap>")) for n in names], F.lit("</sitemapindex>"))
    leaf = F.concat(F.lit("<urlset><url><loc>"), base, F.lit("x</loc></url></urlset>"))
    file = lambda name, body: F.struct(F.concat(base, F.lit(name)).alias("url"), body.alias("body"))
    files = table(spark, sf, "supplier").select(F.inline(F.array(
        file("sitemap.xml", locs(["a.xml", "b.xml"])), file("a.xml", locs(["c.xml", "b.xml"])), file("b.xml", leaf),
        file("c.xml", leaf), file("orphan.xml", leaf))))
    walked = SM.reachable(files, F.col("url").endswith("/sitemap.xml"))
    return walked.select("url", "depth", SM.is_index(F.col("body")).alias("is_index"))


_WORDS = " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w.title()}'" for w in
                  ["polypropylene", "vinyl", "cotton", "polyester", "paper", "fabric", "plastic", "linen", "cloth"])


@query(rf"""WITH t AS (SELECT doc_id, source, text, list_filter(list_transform(string_split_regex(text, '[\n,•/;]+'),
   lambda x: {_STRIP.format(c='x')}), lambda x: x <> '') AS parts,
   string_split_regex(text, '[\n,•/;]+') AS raw,
   regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?') AS words,
   CASE WHEN starts_with(text, source) THEN {_STRIP.format(c='substr(text, length(source) + 1)')} ELSE text END AS body
  FROM documents),
u AS (SELECT *, CASE WHEN strpos(body, 'SPECIFICATIONS') > 1
   THEN {_STRIP.format(c="regexp_replace(body, '(?s)SPECIFICATIONS.*$', '')")} ELSE body END AS cut,
   CASE WHEN len(raw) <= 1 AND length({_STRIP.format(c='raw[1]')}) > 40 THEN words ELSE parts END AS chosen FROM t)
SELECT doc_id, CASE {_WORDS} END AS material,
 CASE WHEN length(text) >= 30 AND length(cut) > 10 THEN md5(left(cut, 5000)) END AS description,
 CAST(least(30, len(list_distinct(chosen))) AS INT) AS colours, chosen[1] AS first_colour,
 nullif({_STRIP.format(c="regexp_extract(text, '(?i)Material" + chr(92) + "s*:" + chr(92) + "s*([^" + chr(92) + "n]+)', 1)")}, '') AS labelled,
 CASE WHEN contains(lower(text), 'ply') THEN 'ply_or_size' ELSE 'other' END AS plain_group FROM u""")
def text_spec_extract(spark, sf) -> DataFrame:
    """Material words, description clean-up, colour lists and labelled lines over whole texts."""
    text = F.col("text")
    rows = table(spark, sf, "documents").select("doc_id", "source", "text", X.colour_list(text, fixed.COLOUR_LIMIT).alias("c"))
    ply = F.when(F.lower(text).contains("ply"), "ply_or_size").otherwise("other")
    return rows.select("doc_id", X.material_word(text).alias("material"),
                       F.md5(X.clean_description(text, F.col("source"), fixed.DESCRIPTION_LIMIT)).alias("description"),
                       F.size("c").alias("colours"), F.get("c", F.lit(0)).alias("first_colour"),
                       X.labelled_line(text, "Material").alias("labelled"), ply.alias("plain_group"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'imprint' WHEN p_type = 'STANDARD' THEN 'napkin'
  WHEN p_size > 25 THEN 'print_method' ELSE 'other' END AS grp,
 CASE WHEN p_size > 25 THEN CAST(p_retailprice AS DOUBLE) + 1000 ELSE 0.0 END AS amount,
 CAST(p_size AS VARCHAR) || 'x24' AS size FROM part""")
def label_rules(spark, sf) -> DataFrame:
    """Step headings to option groups, money texts, sizes in URLs."""
    kind = F.col("p_type")
    label = (F.when(kind.isin("ECONOMY", "SMALL"), "Step 3: Choose INK COLOR (print method)")
             .when(kind == "STANDARD", "step 2 napkin color").when(F.col("p_size") > 25, "Step 1 Select Style here")
             .otherwise("Quantity"))
    price = F.when(F.col("p_size") > 25, F.concat(F.lit(" $1,"), F.lpad(
        F.col("p_retailprice").cast("string"), 5, "0"))).otherwise("call us")
    return table(spark, sf, "part").select(
        "p_partkey", X.option_group(label).alias("grp"), X.money(price).alias("amount"),
        U.size_in_url(F.concat(F.lit("https://a/shop/"), F.col("p_size").cast("string"), F.lit("x24?variant=9")))
         .alias("size"))


@query("""WITH r AS (SELECT source AS site, count(*) AS results, CAST(sum(CASE WHEN 10 + strlen(to_json(text)) > 3000 THEN 1 ELSE 0 END) AS BIGINT)
  AS truncated FROM documents GROUP BY 1),
e AS (SELECT event_type AS site, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT site, results, truncated, CAST(0 AS BIGINT) AS errors FROM r UNION ALL SELECT site, 0, 0, errors FROM e""")
def result_error_log(spark, sf) -> DataFrame:
    """Result envelopes (capped) and error rows appended, read back and counted."""
    store = Store(spark, staging_path(spark, "log"))
    docs = table(spark, sf, "documents")
    data = F.concat(F.lit('{"text":'), P.quoted(F.col("text")), F.lit(" }"))
    store.append("results", docs.select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("source").alias("site"), F.lit("u").alias("url"),
        P.cap_envelope(data, 3000).alias("data"), ts("2024-01-01").alias("created_at")))
    store.append("errors", table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("task_id"), F.col("event_type").alias("site"), F.lit("u").alias("url"),
        F.col("props").alias("error"), F.lit(0).alias("retry_count"), F.col("ts").alias("created_at")))
    cut = F.coalesce(F.try_variant_get(F.try_parse_json("data"), "$.truncated", "boolean"), F.lit(False))
    results = store.read("results").groupBy("site").agg(
        F.count("*").alias("results"), F.count_if(cut).alias("truncated"), F.lit(0).cast("bigint").alias("errors"))
    errors = store.read("errors").groupBy("site").agg(F.count("*").alias("errors"))
    return results.unionByName(errors.select("site", F.lit(0).cast("bigint").alias("results"),
                                             F.lit(0).cast("bigint").alias("truncated"), "errors"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'source-p' ELSE 'source-x' END AS source,
 CASE WHEN o_orderstatus = 'O' THEN 'started' ELSE 'completed' END AS status, count(*) AS sessions,
 CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END) AS BIGINT) AS stored, min(o_orderkey) AS first_order
 FROM orders GROUP BY 1, 2""")
def run_ledger(spark, sf) -> DataFrame:
    """Sessions opened and closed as appended rows; the latest row of each counts.
    Orders of status O were opened and never closed."""
    orders = table(spark, sf, "orders")
    source = F.when(F.col("o_orderstatus") == "P", "source-p").otherwise("source-x")
    session = F.col("o_orderkey").cast("string").alias("session_id")
    opened = orders.select(session, source.alias("source"), F.lit("t").alias("task_id"), F.lit("full").alias("scrape_type"),
                           F.lit("started").alias("status"), F.col("o_orderdate").alias("started_at"),
                           *[F.lit(0).cast("bigint").alias(c) for c in ("products_found", "products_stored", "products_failed")],
                           F.col("o_orderdate").alias("recorded_at"))
    ended = F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")
    closed = orders.filter("o_orderstatus <> 'O'").select(
        session, source.alias("source"), F.lit("completed").alias("status"), ended.alias("completed_at"),
        F.col("o_custkey").alias("products_found"), F.col("o_custkey").alias("products_stored"),
        F.lit(0).cast("bigint").alias("products_failed"), ended.alias("recorded_at"))
    store = Store(spark, staging_path(spark, "ledger"))
    store.append("sessions", opened)
    store.append("sessions", closed)
    latest = latest_sessions(store.read("sessions"))
    return latest.groupBy("source", "status").agg(
        F.count("*").alias("sessions"), F.sum("products_stored").alias("stored"),
        F.min(F.col("session_id").cast("bigint")).alias("first_order"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS session_id, strftime(o_orderdate, '%Y-%m-%d') AS started FROM orders
 WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10""")
def recent_runs(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderstatus").alias("source"),
        F.lit("t").alias("task_id"), F.lit("full").alias("scrape_type"), F.lit("started").alias("status"),
        F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("products_found", "products_stored", "products_failed")],
        F.lit(None).cast("string").alias("error"), F.col("o_orderdate").alias("recorded_at"))
    return recent_sessions(rows, "P", 10).select("session_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


@query("""SELECT url, true AS is_partial FROM pages ORDER BY url, page_id LIMIT 50""")
def capped_run(spark, sf) -> DataFrame:
    rows = paging.capped_run(table(spark, sf, "pages").select("url", "page_id"), [F.col("url"), F.col("page_id")], 50)
    return rows.select("url", "is_partial")


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN NULL ELSE lower(o_orderpriority) END AS site,
  CAST(floor(o_totalprice / 40000) AS INT) AS retries FROM orders)
SELECT CASE WHEN site IS NULL THEN 'site is required' WHEN retries > 10 THEN 'max_retries outside 0-10' END AS problem,
 count(*) AS n FROM v GROUP BY 1""")
def request_validation(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") >= 100000, F.lower("o_orderpriority")).alias("site"),
        F.floor(F.col("o_totalprice") / 40000).cast("int").alias("max_retries"))
    return rows.groupBy(W.task_request_problem().alias("problem")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, user_id AS task_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k
 FROM events GROUP BY 1, 2""")
def event_log(spark, sf) -> DataFrame:
    """Crawl events appended with free-form details, read back and counted."""
    store = Store(spark, staging_path(spark, "events"))
    store.append("event_log", table(spark, sf, "events").select(
        F.lit("shop").alias("source"), "event_type", F.col("user_id").cast("string").alias("task_id"),
        F.from_json("props", "map<string,string>").alias("details"), F.col("ts").alias("timestamp")))
    rows = store.read("event_log", ["event_type", "task_id", "details"])
    return rows.groupBy("event_type", F.col("task_id").cast("bigint").alias("task_id")).agg(
        F.count("*").alias("n"), F.sum(F.try_element_at("details", F.lit("k")).try_cast("bigint")).alias("k"))


@query("""SELECT 'LOGIN' AS activity_type, CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n, min(o_orderkey) AS first_order
 FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""")
def activity_log(spark, sf) -> DataFrame:
    """Activity rows appended and read back; the filter reaches the scan."""
    store = Store(spark, staging_path(spark, "activity"))
    store.append("activity", table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "LOGIN").otherwise("LOGOUT").alias("activity_type"),
        F.lit(True).alias("success"), F.col("o_orderkey").cast("string").alias("details"),
        F.col("o_orderdate").alias("created_at")))
    rows = store.read("activity").filter(W.matching(activity_type="LOGIN"))
    return rows.groupBy("activity_type", "user_id").agg(
        F.count("*").alias("n"), F.min(F.col("details").cast("bigint")).alias("first_order"))
