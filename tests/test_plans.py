"""Plans that have to hold at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from querybook.derived import batch, state, table
from shelfdelta.functions import predicates as W
from shelfdelta.operators import diff as D, discovery as DI, merge as M
from shelfdelta.plans import export, tracked
from shelfdelta.session import cut_lineage

QUERIES = entry_point.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["change_classify", "catalog_merge", "status_apply_guarded", "provider_allowlist_fanout",
                                  "product_rows_expanded", "link_precedence_union", "catalog_page"])
def test_no_nested_loops(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    state_like = spark.range(10).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("product_key"),
                                        F.lit("x").alias("big"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
                                        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    state_like.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).filter(W.products_filter("S", "2024-01-01")).select("product_key")
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(source,s)" in text and "IsNull(deleted_at)" in text and "GreaterThanOrEqual(updated_at" in text
    assert "big" not in text


def test_classification_shuffles_no_payload(spark, sf, tmp_path):
    state(spark, sf).write.parquet(str(tmp_path / "s"))
    batch(spark, sf).write.parquet(str(tmp_path / "b"))
    text = plan(D.classify(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "b"))))
    assert "payload" not in text and text.count("Exchange hashpartitioning") == 2
    applied = M.apply_run(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "b")), F.current_timestamp())
    assert plan(M.new_state(applied)).count("Exchange hashpartitioning") == 2


def test_expansion_needs_no_shuffle(spark, sf):
    from querybook.tiers import _documents
    from shelfdelta.operators import variants as V
    docs = _documents(spark, sf)
    before, after = plan(docs).count("Exchange"), plan(V.expand_variants(docs, 5)).count("Exchange")
    assert before == after


def test_copies_collapse_before_the_shuffle(spark):
    hot = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
                                    F.lit("category").alias("source"), F.col("id").alias("place"))
    found = DI.by_precedence(hot)
    assert "partial_min_by" in plan(found)
    assert found.count() == 20001 and found.filter("url = 'hot'").first().place == 0


def test_one_scan_for_a_mixed_sheet(spark, sf):
    from querybook.tiers import _mixed
    rows = export.S.to_sheet(_mixed(spark, sf))
    assert plan(rows).count("Scan parquet") == plan(_mixed(spark, sf)).count("Scan parquet")
    assert table(spark, sf, "part").count() <= rows.count()


def test_payloads_of_a_run_are_not_broadcast(spark):
    at, doc = F.lit("2024-01-01").cast("timestamp_ntz"), '{"product_id": "a", "name": "%s"}'
    keyed = lambda name, n: D.keyed(spark.range(n).select(F.lit(doc % name).alias("doc")), "shop")
    old, batch = keyed("old", 1), keyed("new", 1)
    index = M.decide(tracked.winners(keyed("none", 0)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"), ("deleted_at", "timestamp_ntz"), ("deleted_by_task", "string"),
        ("last_task_id", "string"), ("scrape_count", "bigint"), ("written", "bigint"), ("seen_in", "bigint"))]), tracked.winners(old), at, 1)
    decided = cut_lineage(M.decide(index, tracked.winners(batch), at, 2), "decided")
    stored = old.select(D.KEY, F.lit(1).cast("bigint").alias("written"), "payload")
    rows = M.fetch(decided, batch, stored)
    joins = [line for line in plan(rows).splitlines() if "Join [" in line and "LeftOuter" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
    row = rows.first()
    assert (row["change_type"], row["old_payload"]["name"], row["new_payload"]["name"]) == ("updated", '"old"', '"new"')
