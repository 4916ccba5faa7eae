"""Provider catalog, statistics and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from querybook.derived import RUNS_SQL, state, table, ts
from shelfdelta.functions.text import cents_amount, country_code, iso_text
from shelfdelta.operators import diff as D, providers as PR, quality, registry as RG, stats
from shelfdelta.plans import export
from shelfdelta.sources.tables import COLLECTIONS

# Suppliers stand for providers; their nation's region gives the country, in the
# mixed spellings real feeds have.
_COUNTRY_SQL = """CASE r_name WHEN 'AMERICA' THEN ' United States of America ' WHEN 'ASIA' THEN 'us'
 WHEN 'EUROPE' THEN 'U.S.' WHEN 'AFRICA' THEN 'Germany' ELSE '' END"""
_ISO_SQL = """CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'ASIA' THEN 'US' WHEN 'EUROPE' THEN 'US'
 WHEN 'AFRICA' THEN 'Germany' ELSE '' END"""


def _providers(spark, sf) -> DataFrame:
    country = (F.when(F.col("r_name") == "AMERICA", " United States of America ").when(F.col("r_name") == "ASIA", "us")
               .when(F.col("r_name") == "EUROPE", "U.S.").when(F.col("r_name") == "AFRICA", "Germany").otherwise(""))
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("name"),
                       country.alias("country"), F.col("s_acctbal").alias("scoring"))


_CENTS = "CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)"
_VARIANTS = f"""WITH v AS (
  SELECT l_partkey, l_suppkey, l_linenumber, min({_CENTS}) AS cents, max(l_linestatus) AS st
  FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT s_suppkey, s_name, {_ISO_SQL} AS iso FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)"""


def _offers(spark, sf) -> DataFrame:
    """Blueprint × provider offers whose variants are the line numbers sold; one
    variant per line number, so an offer's list has at most seven."""
    cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint")
    one = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(
        F.min(cents).alias("cents"), F.max("l_linestatus").alias("st"))
    number = F.col("l_linenumber").cast("bigint")
    variant = F.struct(
        number.alias("id"), F.array(number, number + 100).alias("options"),
        F.array(F.struct(F.col("cents").alias("result"), F.when(F.col("st") == "O", F.col("cents") - 10)
                         .alias("result_subscription"))).alias("costs"),
        F.lit(None).cast("bigint").alias("cost"), F.lit(None).cast("bigint").alias("cost_subscription"),
        F.col("st").alias("status"), (F.col("st") == "O").alias("available"))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))
    items = lambda shift, word: F.transform(numbers, lambda n: F.struct(
        (n + shift).alias("id"), F.concat(F.lit(word), n.cast("string")).alias("label"),
        F.array(F.struct(F.concat(F.lit("#00"), n.cast("string")).alias("hex"))).alias("colors")))
    group = lambda kind, its: F.struct(F.lit(kind).alias("type"), its.alias("items"))
    rate = lambda country, c: F.struct(F.lit(country).alias("country"), c.alias("rate_first"))
    lists = one.groupBy("l_partkey", "l_suppkey").agg(
        F.array_sort(F.collect_list(variant)).alias("variants"), F.min("cents").alias("min_price"))
    return lists.select(
        F.col("l_partkey").alias("blueprint_id"), F.col("l_suppkey").alias("provider_id"), "min_price", "variants",
        F.array(group("color", items(0, "colour ")), group("size", items(100, "size "))).alias("options"),
        F.array(rate("Canada", F.lit(100).cast("bigint")), rate("US", F.col("min_price")),
                rate("United States", F.lit(900).cast("bigint"))).alias("min_shipping"))


def _blueprints(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("blueprint_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.array("p_type").alias("tags"), F.array("p_name").alias("images"))


@query(_VARIANTS + """, o AS (SELECT l_partkey, l_suppkey, min(cents) AS low FROM v GROUP BY 1, 2)
SELECT 'bp' || l_partkey || '_p' || l_suppkey || '_v' || l_linenumber AS product_id, p_name AS title,
 s_name AS provider_name, 'colour ' || l_linenumber AS color_label, '#00' || l_linenumber AS color_hex,
 'size ' || l_linenumber AS size_label, cents AS price_cents, CAST(cents / 100.0 AS DOUBLE) AS price_usd,
 CASE WHEN st = 'O' THEN cents - 10 END AS price_subscription_cents, least(low, 900) AS min_shipping_cents,
 st AS status, st = 'O' AS available
FROM v JOIN o USING (l_partkey, l_suppkey) JOIN p ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE iso = 'US'""")
def provider_allowlist_fanout(spark, sf) -> DataFrame:
    """One record per blueprint, allowed provider and variant."""
    rows = PR.variant_records(_blueprints(spark, sf), _offers(spark, sf), _providers(spark, sf))
    return rows.select("product_id", "title", "provider_name", "color_label", "color_hex", "size_label", "price_cents",
                       "price_usd", "price_subscription_cents", "min_shipping_cents", "status", "available")


@query(_VARIANTS + """, o AS (SELECT l_partkey, l_suppkey, min(cents) AS low FROM v GROUP BY 1, 2)
SELECT 'bp' || l_partkey || '_p' || l_suppkey AS product_id, s_name AS provider_name, low AS price_cents,
 CAST(low / 100.0 AS DOUBLE) AS price_usd, least(low, 900) AS min_shipping_cents
FROM o JOIN p ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE iso = 'US'""")
def provider_summary_records(spark, sf) -> DataFrame:
    rows = PR.provider_records(_blueprints(spark, sf), _offers(spark, sf), _providers(spark, sf))
    return rows.select("product_id", "provider_name", "price_cents", "price_usd", "min_shipping_cents")


@query(f"""SELECT s_suppkey AS provider_id, {_ISO_SQL} AS country_iso, {_ISO_SQL} = 'US' AS allowed
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def provider_countries(spark, sf) -> DataFrame:
    code = country_code(F.col("country"))
    return _providers(spark, sf).select("provider_id", code.alias("country_iso"), (code == "US").alias("allowed"))


@query(f"""WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2000-01-01' AS us,
  {_CENTS} AS rate FROM lineitem)
SELECT l_suppkey, coalesce(min(rate) FILTER (us), min(rate)) AS min_shipping_cents,
 CAST(coalesce(min(rate) FILTER (us), min(rate)) / 100.0 AS DOUBLE) AS min_shipping_usd FROM r GROUP BY 1""")
def min_shipping_fallback(spark, sf) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint")
    us = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= ts("2000-01-01"))
    rates = table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(us, "United States").otherwise("Canada").alias("country"), cents.alias("rate_first"))
    found = PR.min_shipping_by(rates, "l_suppkey")
    return found.withColumn("min_shipping_usd", cents_amount(F.col("min_shipping_cents")))


@query("""WITH c AS (SELECT l_partkey, l_linenumber AS pos, l_suppkey,
  max(CASE WHEN l_returnflag = 'A' THEN 'color' WHEN l_returnflag = 'R' THEN 'size' ELSE 'other' END) AS kind
  FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT l_partkey, kind, arg_max(s_name, (pos, l_suppkey)) AS label FROM c JOIN supplier ON l_suppkey = s_suppkey
  WHERE kind <> 'other' GROUP BY 1, 2)
SELECT l_partkey, coalesce(max(label) FILTER (kind = 'color'), '') AS color_label,
 coalesce(max(label) FILTER (kind = 'size'), '') AS size_label FROM (SELECT DISTINCT l_partkey FROM lineitem)
 LEFT JOIN t USING (l_partkey) GROUP BY 1""")
def option_lookup(spark, sf) -> DataFrame:
    """The last option of each type names a part's colour and size."""
    kind = (F.when(F.col("l_returnflag") == "A", "color").when(F.col("l_returnflag") == "R", "size").otherwise("other"))
    chosen = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber", "l_suppkey").agg(F.max(kind).alias("type"))
    picks = chosen.select("l_partkey", F.struct("l_linenumber", "l_suppkey").alias("pos"),
                          F.col("l_suppkey").alias("option_id"), "type")
    labels = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("option_id"), F.col("s_name").alias("label"),
                                                 F.lit("").alias("hex"))
    return PR.variant_options(picks, labels, ["l_partkey"]).select("l_partkey", "color_label", "size_label")


@query("""SELECT count(*) AS total_products, count(*) FILTER (l_linestatus = 'O') AS available_products,
 count(DISTINCT l_partkey) AS unique_blueprints, count(DISTINCT l_suppkey) AS unique_providers,
 strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS last_scraped_at
 FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' AND l_returnflag <> 'N'""")
def catalog_stats(spark, sf) -> DataFrame:
    """Line items as stored products; late ones are tombstoned, flag N is another source."""
    late = F.col("l_shipdate") >= ts("2001-01-01")
    products = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "other").otherwise("printify").alias("source"),
        F.col("l_partkey").alias("blueprint_id"), F.col("l_suppkey").alias("provider_id"),
        (F.col("l_linestatus") == "O").alias("available"), F.col("l_shipdate").alias("updated_at"),
        F.when(late, F.col("l_shipdate")).alias("deleted_at"))
    found = stats.catalog_stats(products, "Printify")
    return found.withColumn("last_scraped_at", iso_text(F.col("last_scraped_at")))


@query(RUNS_SQL + """SELECT (SELECT count(*) FROM old_run WHERE deleted_at IS NULL
   AND l_shipdate >= TIMESTAMP '1997-01-01') AS products_collection_count,
 (SELECT count(*) FROM documents) AS results_collection_count,
 (SELECT count(*) FROM (SELECT source FROM old_run UNION SELECT source FROM documents)) AS available_sources,
 CAST(206 AS BIGINT) AS csv_columns_count""")
def export_stats(spark, sf) -> DataFrame:
    results = table(spark, sf, "documents").select(F.col("source").alias("site"), ts("2024-01-01").alias("created_at"))
    return stats.export_stats(state(spark, sf), results, start="1997-01-01")


@query(RUNS_SQL + "SELECT source FROM documents UNION SELECT source FROM old_run")
def sources_union(spark, sf) -> DataFrame:
    return stats.known_sources(state(spark, sf), table(spark, sf, "documents").withColumnRenamed("source", "site"))


@query(RUNS_SQL + "SELECT source, count(*) AS n FROM old_run WHERE deleted_at IS NULL GROUP BY source")
def products_by_source(spark, sf) -> DataFrame:
    return stats.count_by(state(spark, sf).filter(F.col("deleted_at").isNull()), "source")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def uniqueness_audit(spark, sf) -> DataFrame:
    return quality.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# -- registry ------------------------------------------------------------------
# Stored scrapers are nations, declared ones suppliers' nations with account data.

def _stored_registry(spark, sf) -> DataFrame:
    meta = F.struct(F.col("n_name").alias("description"), F.lit("1.0.0").alias("version"), F.lit("").alias("author"),
                    F.array("r_name").alias("tags"), F.array().cast("array<string>").alias("supported_features"),
                    F.lit(60).alias("rate_limit_per_minute"), F.lit(False).alias("requires_javascript"),
                    F.lit(30).alias("default_timeout_seconds"))
    status = F.when(F.col("r_name") == "ASIA", "inactive").when(F.col("r_name") == "AFRICA", "deprecated").otherwise("active")
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.lower("n_name").alias("site_id"), F.col("n_name").alias("name"),
                       F.lit(None).cast("string").alias("base_url"), status.alias("status"), meta.alias("metadata"),
                       ts("2023-01-01").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def _declared(spark, sf) -> DataFrame:
    """Nations with a supplier below zero balance, and every customer segment."""
    poor = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select("s_nationkey").distinct()
    nations = table(spark, sf, "nation").join(poor, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(
        F.lower("n_name").alias("site_id"), F.col("n_name").alias("name"))
    segments = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("site_id"),
                                                   F.col("c_mktsegment").alias("name")).distinct()
    return nations.union(segments).withColumn("status", F.lit("active")).withColumn("created_at", ts("2024-02-01"))


_DECLARED = """d AS (SELECT lower(n_name) AS site_id, n_name AS name FROM nation
  WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)
 UNION ALL SELECT DISTINCT lower(c_mktsegment), c_mktsegment FROM customer)"""


@query(f"""WITH {_DECLARED}
SELECT site_id, d.name, 'active' AS status,
 CASE WHEN n_name IS NULL THEN '2024-02-01' ELSE '2023-01-01' END AS created FROM d LEFT JOIN nation
 ON lower(n_name) = site_id
UNION ALL SELECT lower(n_name), NULL, 'removed', NULL FROM nation WHERE lower(n_name) NOT IN (SELECT site_id FROM d)""")
def registry_sync(spark, sf) -> DataFrame:
    stored, declared = _stored_registry(spark, sf), _declared(spark, sf)
    synced = RG.sync(stored, declared, ts("2024-02-02")).select(
        "site_id", "name", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))
    gone = RG.stale(stored, declared).select("site_id", F.lit(None).cast("string").alias("name"),
                                             F.lit("removed").alias("status"), F.lit(None).cast("string").alias("created"))
    return synced.union(gone)


_STATUS = "CASE r_name WHEN 'ASIA' THEN 'inactive' WHEN 'AFRICA' THEN 'deprecated' ELSE 'active' END"


@query(f"""SELECT coalesce(s, 'total') AS status, count(*) AS n FROM (SELECT {_STATUS} AS s FROM nation
 JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (s)""")
def registry_stats(spark, sf) -> DataFrame:
    return stats.registry_stats(_stored_registry(spark, sf))


@query(f"""SELECT lower(n_name) AS site_id, n_name AS name, '' AS base_url, {_STATUS} AS status, n_name AS description,
 r_name AS tags FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {_STATUS} = 'active'""")
def registry_listing(spark, sf) -> DataFrame:
    return RG.listing(_stored_registry(spark, sf)).withColumn("tags", F.array_join("tags", "|"))


@query(f"""SELECT lower(n_name) AS site_id, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier
  WHERE s_acctbal < 0) THEN 'inactive' ELSE {_STATUS} END AS status,
 CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN '2024-02-03' END AS updated
 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def registry_status_change(spark, sf) -> DataFrame:
    poor = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    moves = poor.select(F.lower("n_name").alias("site_id"), F.lit("inactive").alias("new_status")).distinct()
    out = RG.set_status(_stored_registry(spark, sf), moves, ts("2024-02-03"))
    return out.select("site_id", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
