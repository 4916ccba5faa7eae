"""Change tracking, merge and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querybook import query
from querybook.derived import CUT, FIRST_TS, RUNS_SQL, RUN_TS, batch, state, table, ts
from shelfdelta.functions import payload as P, predicates as W
from shelfdelta.functions.text import iso_text
from shelfdelta.operators import diff as D, merge as M, paging, quality, stats
from shelfdelta.session import staging_path
from shelfdelta.sources.tables import Store, snapshot_rows

_BODY = """'{' || CASE WHEN %(d)s THEN '"deal":true,' ELSE '' END || '"flag":"' || %(f)s || '","name":"'
 || name || '","product_id":"' || product_id || '"}'"""
_LIST = """CASE WHEN %(d)s THEN 'deal: True; ' ELSE '' END || 'flag: ' || %(f)s || '; name: '
 || name || '; product_id: ' || product_id"""


@query(RUNS_SQL + "SELECT product_key, source, change_type, revived FROM classified WHERE change_type IS NOT NULL")
def change_classify(spark, sf) -> DataFrame:
    return D.classify(state(spark, sf), batch(spark, sf)).select("product_key", "source", "change_type", "revived")


@query(RUNS_SQL + """SELECT source, count(*) AS total_changes, count(*) FILTER (change_type = 'added') AS added,
 count(*) FILTER (change_type = 'updated') AS updated, count(*) FILTER (change_type = 'deleted') AS deleted,
 count(*) FILTER (change_type = 'unchanged') AS unchanged
 FROM classified WHERE change_type IS NOT NULL GROUP BY source""")
def change_stats_by_source(spark, sf) -> DataFrame:
    found = stats.change_stats(D.classify(state(spark, sf), batch(spark, sf)))
    count = lambda t: F.coalesce(F.try_element_at("by_type", F.lit(t)), F.lit(0)).alias(t)
    return found.select("source", "total_changes", *[count(t) for t in ("added", "updated", "deleted", "unchanged")])


@query(RUNS_SQL + """SELECT 'shop-3' AS source, CAST(365 AS BIGINT) AS period_days,
 count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'updated') AS updated,
 count(*) FILTER (change_type = 'deleted') AS deleted, count(*) AS total_changes
 FROM classified WHERE change_type IN ('added', 'updated', 'deleted') AND source = 'shop-3'
 AND coalesce(new_shipped, old_shipped) >= TIMESTAMP '2001-06-01' - INTERVAL 365 DAYS""")
def change_summary_window(spark, sf) -> DataFrame:
    # The change is dated by the item's last shipment, so the window has both sides.
    seen = batch(spark, sf).select("product_key", "shipped")
    known = state(spark, sf).select("product_key", F.col("updated_at").alias("before"))
    kinds = D.classify(state(spark, sf), batch(spark, sf)).filter("change_type <> 'unchanged'")
    dated = kinds.join(seen, "product_key", "left").join(known, "product_key", "left").withColumn(
        "created_at", F.coalesce("shipped", "before"))
    return stats.change_summary(dated, ts("2001-06-01"), " SHOP-3 ", days=365)


@query(RUNS_SQL + """SELECT product_key, source, kind, field, old_value, new_value FROM (
  SELECT product_key, source, 'changed' AS kind, 'flag' AS field, '"' || old_flag || '"' AS old_value,
         '"' || new_flag || '"' AS new_value FROM classified WHERE change_type = 'updated' AND old_flag <> new_flag
  UNION ALL SELECT product_key, source, 'added', 'deal', NULL, 'true' FROM classified
   WHERE change_type = 'updated' AND new_deal AND NOT old_deal
  UNION ALL SELECT product_key, source, 'removed', 'deal', 'true', NULL FROM classified
   WHERE change_type = 'updated' AND old_deal AND NOT new_deal)""")
def field_diff(spark, sf) -> DataFrame:
    records = D.change_records(state(spark, sf), batch(spark, sf), ts(RUN_TS))
    return D.changed_fields(records)


@query(RUNS_SQL + f"""SELECT change_type, source, product_id, name AS product_name, product_key, 'run-2' AS task_id,
 's-2' AS session_id, '2024-02-01T00:00:00' AS created_at,
 CASE change_type WHEN 'added' THEN {_LIST % dict(d='new_deal', f='new_flag')}
   WHEN 'updated' THEN CASE WHEN new_deal AND NOT old_deal THEN 'deal: True' ELSE '' END ELSE '' END AS added_fields,
 CASE change_type WHEN 'deleted' THEN {_LIST % dict(d='old_deal', f='old_flag')}
   WHEN 'updated' THEN CASE WHEN old_deal AND NOT new_deal THEN 'deal: True' ELSE '' END ELSE '' END AS removed_fields,
 CASE WHEN change_type = 'updated' AND old_flag <> new_flag THEN 'flag: ' || old_flag || ' → ' || new_flag
   ELSE '' END AS changed_fields
 FROM classified WHERE change_type IN ('added', 'updated', 'deleted')""")
def audit_log_text(spark, sf) -> DataFrame:
    applied = M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2")
    return D.change_log(M.records_of(applied, ts(RUN_TS), "run-2", "s-2"))


@query("""SELECT doc_id, source, CASE WHEN size > 2000 THEN true ELSE false END AS capped,
 CASE WHEN size > 2000 THEN CAST(size AS VARCHAR) END AS size_bytes,
 CASE WHEN size > 2000 THEN NULL ELSE lang END AS lang,
 strlen(to_json(text)) > 800 AS field_capped FROM (
  SELECT *, strlen('{"lang":' || to_json(lang) || ',"text":' || to_json(text) || '}') AS size FROM documents)""")
def audit_payload_cap(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    body = P.of_columns({"text": F.col("text"), "lang": F.col("lang")})
    rows = docs.select("doc_id", "source", P.cap(body, 2000).alias("p"), P.quoted(F.col("text")).alias("t"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    return rows.select("doc_id", "source", F.coalesce(at("payload_truncated") == "true", F.lit(False)).alias("capped"),
                       at("size_bytes").alias("size_bytes"), P.shown(at("lang")).alias("lang"),
                       P.cap_value(F.col("t"), 800).startswith("{").alias("field_capped"))


@query(RUNS_SQL + f"""SELECT source, product_key,
 {_BODY % dict(d='coalesce(new_deal, false) OR coalesce(old_deal, false)', f='coalesce(new_flag, old_flag)')} AS body,
 coalesce(new_hash, old_hash) AS data_hash,
 CASE WHEN stored THEN '{FIRST_TS[:10]}' ELSE '{RUN_TS[:10]}' END AS created,
 CASE WHEN active THEN NULL WHEN old_deleted_at IS NULL THEN '{RUN_TS[:10]}' ELSE '{FIRST_TS[:10]}' END AS deleted,
 CASE WHEN NOT active AND old_deleted_at IS NULL THEN 'run-2' WHEN old_deleted_at IS NOT NULL THEN 'run-0' END
  AS deleted_by_task,
 CASE WHEN active THEN 'run-2' ELSE 'run-1' END AS last_task_id,
 CAST(active AS BIGINT) + CAST(stored AS BIGINT) AS scrape_count FROM classified""")
def catalog_merge(spark, sf) -> DataFrame:
    merged = M.new_state(M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return merged.select("source", "product_key", P.canonical_text(F.col("payload")).alias("body"), "data_hash",
                         day("created_at").alias("created"), day("deleted_at").alias("deleted"),
                         "deleted_by_task", "last_task_id", "scrape_count")


@query(RUNS_SQL + """SELECT source, count(*) FILTER (NOT stored) AS inserted,
 count(*) FILTER (active AND stored) AS stored_again, count(*) FILTER (change_type = 'added') AS added,
 count(*) FILTER (change_type = 'updated') AS updated, count(*) FILTER (change_type = 'deleted') AS deleted,
 count(*) FILTER (change_type = 'unchanged') AS unchanged, count(*) FILTER (change_type = 'deleted') AS soft_deleted,
 count(*) FILTER (revived) AS revived, count(*) FILTER (active) AS active_keys FROM classified GROUP BY source""")
def run_counters(spark, sf) -> DataFrame:
    return M.run_counters(M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2"), ["source"])


@query(RUNS_SQL + """SELECT source, product_key, true AS newly_deleted FROM classified
 WHERE stored AND NOT active AND old_deleted_at IS NULL""")
def tombstone_sweep(spark, sf) -> DataFrame:
    marked = M.tombstone_missing(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2")
    return marked.filter("newly_deleted").select("source", "product_key", "newly_deleted")


@query(RUNS_SQL + """SELECT source, count(*) FILTER (change_type = 'added') AS added,
 count(*) FILTER (change_type = 'updated') AS updated, CAST(0 AS BIGINT) AS deleted,
 count(*) FILTER (coalesce(old_deleted_at IS NULL, true) OR active) AS alive FROM classified GROUP BY source""")
def tombstone_partial(spark, sf) -> DataFrame:
    """A partial run deletes nothing; what it does see is revived."""
    applied = M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2", partial=True)
    kind = F.col("change_type")
    return applied.groupBy("source").agg(
        F.count_if(kind == "added").alias("added"), F.count_if(kind == "updated").alias("updated"),
        F.count_if(kind == "deleted").alias("deleted"), F.count_if(F.col("deleted_at").isNull()).alias("alive"))


@query(RUNS_SQL + """SELECT product_key, 'only_new' AS side FROM (SELECT product_key FROM new_run
 EXCEPT SELECT product_key FROM old_run) UNION ALL SELECT product_key, 'only_old' FROM (SELECT product_key FROM old_run
 EXCEPT SELECT product_key FROM new_run) UNION ALL SELECT product_key, 'both' FROM (SELECT product_key FROM old_run
 INTERSECT SELECT product_key FROM new_run)""")
def key_sets(spark, sf) -> DataFrame:
    old, new = state(spark, sf), batch(spark, sf)
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(D.key_difference(new, old), "only_new").union(side(D.key_difference(old, new), "only_old")).union(
        side(D.key_intersection(old, new), "both"))


@query(RUNS_SQL + """SELECT product_key, 'added' AS change_type FROM new_run ANTI JOIN old_run USING (product_key)
 UNION ALL SELECT n.product_key, CASE WHEN n.data_hash = o.data_hash THEN 'unchanged' ELSE 'updated' END
 FROM new_run n JOIN old_run o USING (product_key)
 UNION ALL SELECT product_key, 'deleted' FROM (SELECT * FROM old_run WHERE deleted_at IS NULL)
 ANTI JOIN new_run USING (product_key)""")
def change_parts(spark, sf) -> DataFrame:
    """The three separate joins that the classifier does in one."""
    old, new = state(spark, sf), batch(spark, sf)
    named = lambda df, kind: df.select("product_key", F.lit(kind).alias("change_type"))
    return named(D.added(old, new), "added").union(
        D.matched(old, new).select("product_key", "change_type")).union(named(D.missing(old, new), "deleted"))


@query(RUNS_SQL + """SELECT source, product_key, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM old_run
 WHERE source = 'shop-2' AND deleted_at IS NULL
 AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""")
def alive_export_filter(spark, sf) -> DataFrame:
    kept = state(spark, sf).filter(W.products_filter("  Shop-2", "1997-01-01", "1997-12-31"))
    return kept.select("source", "product_key", iso_text(F.col("updated_at")).alias("updated_at"))


@query(RUNS_SQL + """, page AS (SELECT source, product_key, l_shipdate FROM old_run WHERE source = 'shop-4'
   AND deleted_at IS NULL)
 SELECT product_key, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS updated_at, (SELECT count(*) FROM page) AS total,
 CAST(3 AS BIGINT) AS page, CAST(25 AS BIGINT) AS page_size,
 CAST(ceil((SELECT count(*) FROM page) / 25.0) AS BIGINT) AS total_pages, (SELECT count(*) FROM page) > 75 AS has_next
 FROM page ORDER BY l_shipdate DESC, product_key LIMIT 25 OFFSET 50""")
def catalog_page(spark, sf) -> DataFrame:
    rows = state(spark, sf).filter(W.every(W.same_source("shop-4"), W.alive())).select(
        "product_key", "updated_at")
    out = paging.paged(rows, [F.col("updated_at").desc(), F.col("product_key")], 3, 25)
    return out.withColumn("updated_at", iso_text(F.col("updated_at")))


@query(RUNS_SQL + """SELECT product_key, change_type, strftime(created_at, '%Y-%m-%d') AS created FROM (
 SELECT product_key, change_type, coalesce(new_shipped, old_shipped) AS created_at FROM classified
 WHERE change_type = 'updated' AND source = 'shop-1')
 WHERE (created_at, product_key) < (TIMESTAMP '2001-01-01', 'shop-1:p5-1') AND created_at >= TIMESTAMP '2000-01-01'
 ORDER BY created_at DESC, product_key DESC LIMIT 40""")
def change_page(spark, sf) -> DataFrame:
    """A page addressed by the last row of the page before it."""
    seen = batch(spark, sf).select("product_key", F.col("shipped").alias("created_at"))
    rows = D.classify(state(spark, sf), batch(spark, sf)).join(seen, "product_key").filter(
        W.changes_filter("shop-1", None, "updated", "2000-01-01"))
    after = (F.col("created_at") < ts("2001-01-01")) | (
        (F.col("created_at") == ts("2001-01-01")) & (F.col("product_key") < "shop-1:p5-1"))
    out = paging.page_after(rows, after, [F.col("created_at").desc(), F.col("product_key").desc()], 40)
    return out.select("product_key", "change_type", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(RUNS_SQL + """SELECT source, count(*) AS checked, CAST(0 AS BIGINT) AS disagreeing FROM old_run
 GROUP BY source""")
def hash_agreement_audit(spark, sf) -> DataFrame:
    return quality.hash_agreement(state(spark, sf))


@query("""SELECT product_key, CAST(n AS BIGINT) AS copies, flag FROM (
 SELECT 'shop-' || l_linenumber || ':p' || l_partkey || '-' || l_linenumber AS product_key, count(*) AS n,
  arg_max(l_returnflag, (l_shipdate, l_orderkey, l_extendedprice, l_returnflag)) AS flag
 FROM lineitem GROUP BY l_partkey, l_linenumber)""")
def batch_last_wins(spark, sf) -> DataFrame:
    """Copies of a key inside one run: the last stands, none is lost from the count."""
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("shop-"), F.col("l_linenumber").cast("string"), F.lit(":p"), F.col("l_partkey").cast("string"),
                 F.lit("-"), F.col("l_linenumber").cast("string")).alias("product_key"),
        "l_shipdate", "l_orderkey", "l_extendedprice", F.col("l_returnflag").alias("flag"))
    latest = D.latest_per_key(rows, "product_key", ["l_shipdate", "l_orderkey", "l_extendedprice", "flag"])
    copies = rows.groupBy("product_key").agg(F.count("*").alias("copies"))
    return latest.join(copies, "product_key").select("product_key", "copies", "flag")


@query(RUNS_SQL + """SELECT 'pre_scrape' AS snapshot_type, source, count(*) AS keys, min(data_hash) AS low FROM old_run GROUP BY source
 UNION ALL SELECT 'post_scrape', source, count(*), min(data_hash) FROM new_run GROUP BY source""")
def run_snapshots(spark, sf) -> DataFrame:
    """Keys and hashes before and after a run, stored as rows."""
    store = Store(spark, staging_path(spark, "snapshots"))
    store.append("snapshots", snapshot_rows(state(spark, sf), "run-2", "pre_scrape", ts(RUN_TS)))
    store.append("snapshots", snapshot_rows(batch(spark, sf), "run-2", "post_scrape", ts(RUN_TS)))
    return store.read("snapshots").groupBy("snapshot_type", "source").agg(
        F.count("*").alias("keys"), F.min("data_hash").alias("low"))


@query(RUNS_SQL + """SELECT product_key, source, CASE WHEN old_deleted_at IS NULL THEN false ELSE true END AS was_gone,
 product_id, name FROM classified WHERE active AND stored""")
def stored_products(spark, sf) -> DataFrame:
    """The run's products that storage knew, with fields read out of the merged payload."""
    applied = M.apply_run(state(spark, sf), batch(spark, sf), ts(RUN_TS), "run-2")
    kept = applied.filter(F.col("active") & (F.col("change_type") != "added"))
    body = F.col("payload")
    return kept.select("product_key", "source", F.col("revived").alias("was_gone"),
                       P.text_value(body, "product_id", "sku").alias("product_id"),
                       P.text_value(body, "title", "name").alias("name"))
