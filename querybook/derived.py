"""Collections derived from the driver tables, in Spark and in SQL.

Two runs of a catalog come from ``lineitem``: an item is (part, line number), its
row in a run the last one shipped before, or since, a cut-off date. Both runs read
the whole table. An item of the first run that was last shipped before 1996 counts
as tombstoned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfdelta.functions import keys, payload as P

CUT = "1998-06-01"
STALE = "1996-01-01"
RUN_TS = "2024-02-01 00:00:00"
FIRST_TS = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores. The driver tables are single small files, so work that is
    heavy per row would otherwise run in one task; AQE merges key partitions of few
    bytes, hence the explicit number."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _items(lineitem: DataFrame) -> DataFrame:
    """The last row of every item, by ship date and then by every other column used."""
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_extendedprice", "l_returnflag", "l_discount"))
    rows = lineitem.groupBy("l_partkey", "l_linenumber").agg(last.alias("r")).select(
        "l_partkey", "l_linenumber", "r.*")
    source = F.concat(F.lit("shop-"), F.col("l_linenumber").cast("string"))
    product_id = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"),
                          F.col("l_linenumber").cast("string"))
    name = F.concat(F.lit("item "), F.col("l_partkey").cast("string"))
    always = P.of_columns({"product_id": product_id, "name": name, "flag": F.col("l_returnflag")})
    deal = F.when(F.col("l_discount") >= 0.05, P.of_columns(raw={"deal": F.lit("true")})).otherwise(
        F.create_map().cast("map<string,string>"))
    return rows.select(
        source.alias("source"), keys.product_key(source, product_id).alias("product_key"),
        F.map_concat(always, deal).alias("payload"), "l_shipdate", "l_extendedprice").withColumn(
        "data_hash", P.content_hash(F.col("payload")))


def state(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog after the first run."""
    rows = _items(table(spark, sf, "lineitem").filter(F.col("l_shipdate") < ts(CUT)))
    gone = F.col("l_shipdate") < ts(STALE)
    return rows.select(
        "source", "product_key", "payload", "data_hash", ts(FIRST_TS).alias("created_at"),
        F.col("l_shipdate").alias("updated_at"), F.when(gone, ts(FIRST_TS)).alias("deleted_at"),
        F.when(gone, "run-0").alias("deleted_by_task"), F.lit("run-1").alias("last_task_id"),
        F.lit(1).cast("bigint").alias("scrape_count"))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """The second run."""
    return _items(table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= ts(CUT))).select(
        "source", "product_key", "payload", "data_hash", F.col("l_shipdate").alias("shipped"))


def _run_sql(name: str, cond: str) -> str:
    return f"""
{name}_last AS (
  SELECT * FROM (
    SELECT l_partkey, l_linenumber, l_shipdate, l_returnflag, l_discount, row_number() OVER (
      PARTITION BY l_partkey, l_linenumber
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC, l_returnflag DESC, l_discount DESC) AS rn
    FROM lineitem WHERE l_shipdate {cond} TIMESTAMP '{CUT}') WHERE rn = 1),
{name} AS (
  SELECT source, source || ':' || product_id AS product_key, product_id, name, flag, deal, l_shipdate,
         left(sha256('{{' || CASE WHEN deal THEN '"deal":true,' ELSE '' END || '"flag":"' || flag || '","name":"'
              || name || '","product_id":"' || product_id || '"}}'), 32) AS data_hash
  FROM (SELECT 'shop-' || l_linenumber AS source, 'p' || l_partkey || '-' || l_linenumber AS product_id,
               'item ' || l_partkey AS name, l_returnflag AS flag, l_discount >= 0.05 AS deal, l_shipdate
        FROM {name}_last))"""


RUNS_SQL = f"""WITH {_run_sql('o', '<')}, {_run_sql('n', '>=')},
old_run AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '{STALE}' THEN TIMESTAMP '{FIRST_TS}' END AS deleted_at FROM o),
new_run AS (SELECT * FROM n),
classified AS (
  SELECT coalesce(n.product_key, o.product_key) AS product_key, coalesce(n.source, o.source) AS source,
    CASE WHEN o.product_key IS NULL THEN 'added'
         WHEN n.product_key IS NOT NULL AND o.data_hash <> n.data_hash THEN 'updated'
         WHEN n.product_key IS NOT NULL THEN 'unchanged'
         WHEN o.deleted_at IS NULL THEN 'deleted' END AS change_type,
    n.product_key IS NOT NULL AND o.deleted_at IS NOT NULL AS revived,
    o.flag AS old_flag, n.flag AS new_flag, o.deal AS old_deal, n.deal AS new_deal,
    coalesce(n.name, o.name) AS name, coalesce(n.product_id, o.product_id) AS product_id,
    o.data_hash AS old_hash, n.data_hash AS new_hash, o.l_shipdate AS old_shipped, n.l_shipdate AS new_shipped,
    o.deleted_at AS old_deleted_at, n.product_key IS NOT NULL AS active, o.product_key IS NOT NULL AS stored
  FROM old_run o FULL OUTER JOIN new_run n ON o.product_key = n.product_key)
"""


# -- nested product documents --------------------------------------------------
# A product is a part. Its flat pricing comes from its line items: print method =
# return flag, shape = line status, and one price per (method, shape, quantity), the
# first by (price, order). That pre-aggregation runs map-side, so the list a product
# collects is bounded by the number of distinct methods, shapes and quantities.

def price_rows(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint")
    return items.groupBy("l_partkey", F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("shape"),
                         F.col("l_quantity").cast("bigint").alias("quantity")).agg(F.min(cents).alias("cents"))


PRICE_SQL = """price_rows AS (
  SELECT l_partkey, l_returnflag AS method, l_linestatus AS shape, CAST(l_quantity AS BIGINT) AS quantity,
         min(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS cents
  FROM lineitem GROUP BY ALL)"""

METHODS = {"A": "Foil Stamp", "N": "", "R": "Full/Color Print"}
METHOD_SQL = "CASE method WHEN 'A' THEN 'Foil Stamp' WHEN 'N' THEN '' ELSE 'Full/Color Print' END"


def method_name() -> Column:
    return F.when(F.col("method") == "A", "Foil Stamp").when(F.col("method") == "N", "").otherwise("Full/Color Print")


def priced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with ``pricing`` as a nested list ordered by (method, shape, quantity)."""
    entry = F.struct("method", "shape", "quantity", "cents")
    lists = price_rows(spark, sf).groupBy("l_partkey").agg(F.array_sort(F.collect_list(entry)).alias("raw"))
    name = lambda m: F.when(m == "A", "Foil Stamp").when(m == "N", "").otherwise("Full/Color Print")
    pricing = F.transform("raw", lambda e: F.struct(
        name(e["method"]).alias("print_method"), e["shape"].alias("shape"),
        F.lit("4 in").alias("size"), e["quantity"].alias("quantity"), (e["cents"] / 100.0).alias("unit_price")))
    parts = spread(table(spark, sf, "part"), "p_partkey")
    return parts.join(lists, parts["p_partkey"] == lists["l_partkey"], "left").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        F.concat(F.lit("https://shop.example.com/product/"), F.lower("p_type"), F.lit("/"),
                 F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
         .alias("product_url"), pricing.alias("pricing"))


URL_SQL = ("'https://shop.example.com/product/' || lower(p_type) || '/' || replace(p_name, ' ', '-') "
           "|| '-' || p_partkey")
SLUG_SQL = "replace(p_name, ' ', '-') || '-' || p_partkey"
# A dollar amount of whole cents, as the sheet prints it.
DOLLAR_SQL = "CAST({c} / 100.0 AS DOUBLE)"
