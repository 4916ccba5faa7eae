"""Exports written as files and read back: outcomes, results, change log, blueprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import SQL, query
from querybook.changes import RUN_TS, ts
from querybook.derived import batch, state, table
from shelfdelta.functions import fixed
from shelfdelta.operators import merge as M
from shelfdelta.plans import export
from shelfdelta.session import staging_path
from shelfdelta.sources import csv_files


def _documents(spark, sf) -> DataFrame:
    """Parts as JSON texts, of every ten one with a price that is none, one with a tier of no pieces and a negative
    price, one that is no JSON and one with two bad fields."""
    kind, key = F.col("p_partkey") % 10, F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    tier = F.array(F.struct(F.when(kind == 2, 0).otherwise(25).alias("quantity"), F.when(kind == 2, -1.5).otherwise(1.5).alias("unit_price")))
    doc = F.to_json(F.struct(
        F.concat(F.lit("v"), key).alias("product_id"), F.col("p_name").alias("title"), F.when(kind == 1, "ask us").otherwise(cents).alias("price_cents"),
        F.when(kind == 4, "x").otherwise((key % 50).cast("string")).alias("blueprint_id"), F.when(kind == 4, "maybe").otherwise("true").alias("available"),
        tier.alias("base_tiers")))
    return table(spark, sf, "part").select(key, F.when(kind == 3, F.concat(F.lit("{broken "), key)).otherwise(doc).alias("doc"))


@query("""
    WITH p AS (SELECT *, p_partkey % 10 AS kind FROM part)
    SELECT p_partkey, CASE WHEN kind IN (1, 2, 3, 4) THEN 'bad' ELSE 'good' END AS outcome, 
           CASE WHEN kind IN (3, 4) THEN 'BP' ELSE 'BP' || CAST(p_partkey % 50 AS VARCHAR) END AS supplier_sku, '' AS "column", '' AS reason, false AS is_error,
           (SELECT count(*) FROM p) AS n_rows, (SELECT count(*) FROM p WHERE kind BETWEEN 1 AND 4) AS n_bad FROM p
    UNION ALL
    SELECT p_partkey, 'bad', '', e."column", e.reason, true, (SELECT count(*) FROM p), (SELECT count(*) FROM p WHERE kind BETWEEN 1 AND 4)
    FROM p JOIN (VALUES (1, 'price_cents', 'no bigint'), (2, 'base_tiers', 'quantity'), (2, 'base_tiers', 'price'),
                        (3, 'document', 'no JSON object'), (4, 'blueprint_id', 'no bigint'), (4, 'available', 'no boolean')) e(kind, "column", reason) USING (kind)""")
def export_outcomes(spark, sf) -> DataFrame:
    """Every row that went in comes out once, good or bad, and every problem has a row of its own."""
    path = staging_path(spark, "outcomes")
    counts = export.write_by_outcome(export.checked_sheet(_documents(spark, sf), "printify", keep=["p_partkey"]), path)
    back = spark.read.parquet(path)
    none, sizes = F.lit(""), [F.lit(counts["rows"]).alias("n_rows"), F.lit(counts["bad"]).alias("n_bad")]
    rows = back.select("p_partkey", "outcome", F.col("`Supplier SKU`").alias("supplier_sku"), none.alias("column"), none.alias("reason"),
                       F.lit(False).alias("is_error"), *sizes)
    errors = export.error_rows(back, ["p_partkey"]).select("p_partkey", F.lit("bad").alias("outcome"), none.alias("supplier_sku"), "column", "reason",
                                                           F.lit(True).alias("is_error"), *sizes)
    return rows.unionByName(errors)


@query("""
    SELECT upper(site) AS source, 'r' || p_partkey || '-' || i AS supplier_sku, p_name AS name FROM (
      SELECT *, CASE WHEN p_size % 2 = 0 THEN 'shop' ELSE 'other' END AS site, unnest(CASE WHEN p_size % 3 = 0 THEN [1, 2] ELSE [1] END) AS i FROM part)
    WHERE site = 'shop'""")
def results_csv(spark, sf) -> DataFrame:
    """Stored result envelopes of one site, filtered by its name, as a CSV sheet read back."""
    key = F.col("p_partkey").cast("string")
    product = lambda i: F.struct(F.concat(F.lit("r"), key, F.lit(f"-{i}")).alias("sku"), F.col("p_name").alias("name"))
    body = F.when(F.col("p_size") % 3 == 0, F.array(product(1), product(2))).otherwise(F.array(product(1)))
    envelopes = table(spark, sf, "part").select(
        F.when(F.col("p_size") % 2 == 0, "shop").otherwise("other").alias("site"), F.to_json(F.struct(body.alias("products"))).alias("data"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    path = staging_path(spark, "results-csv")
    csv_files.write(export.result_rows(envelopes, " shop "), path)
    back = csv_files.read(spark, path, fixed.sheet_columns())
    return back.select(F.col("Source").alias("source"), F.col("`Supplier SKU`").alias("supplier_sku"), F.col("`Product Name`").alias("name"))


@query(SQL["audit_log_text"])
def change_log_csv(spark, sf) -> DataFrame:
    """The change log of a run as CSV files, read back: the same eleven columns."""
    applied = M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2")
    path = staging_path(spark, "changes-csv")
    export.changes_csv(M.records_of(applied, ts(RUN_TS), "run-2", "s-2"), path)
    return csv_files.read(spark, path, fixed.CHANGE_LOG_COLUMNS)


@query("""
    SELECT 'BP' || (p_partkey % 50) AS supplier_sku, 'v' || p_partkey AS variant_sku, p_name AS name
    FROM part WHERE p_size % 7 = 3 AND p_size % 5 <> 0""")
def blueprint_sheet_csv(spark, sf) -> DataFrame:
    """One provider's blueprints without tombstones, written in blueprint order and read back."""
    docs = table(spark, sf, "part").select(
        F.lit("printify").alias("source"), F.concat(F.lit("v"), F.col("p_partkey")).alias("product_id"), (F.col("p_partkey") % 50).cast("bigint").alias("blueprint_id"),
        (F.col("p_size") % 7).cast("bigint").alias("provider_id"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 5 == 0, F.lit("2024-01-01")).cast("timestamp_ntz").alias("deleted_at"))
    path = staging_path(spark, "blueprints-csv")
    export.blueprint_csv(docs, path, provider_id=3)
    back = csv_files.read(spark, path, fixed.sheet_columns())
    return back.select(F.col("`Supplier SKU`").alias("supplier_sku"), F.col("`Variant SKU`").alias("variant_sku"), F.col("`Product Name`").alias("name"))
