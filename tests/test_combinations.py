"""Numbered combinations against the list that the documents hold."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from shelfdelta.functions import fixed
from shelfdelta.operators import combinations as C, variants as V
from shelfdelta.schemas import OPTION, TIER

_SCHEMA = f"id int, options map<string,array<{OPTION}>>, tiers array<{TIER}>, slug string, tag string"


def axis(name, n):
    return [(f"{name} {i}/x", str(i), "1", 0.1 * i if i % 3 else None, None, "") for i in range(n)]


def frame(spark, sizes):
    rows = [(i, None if s is None else {a: axis(a, n) for a, n in zip(fixed.VARIANT_AXES, s) if n is not None},
             [(25, 1.5, False, False)] if i % 2 == 0 else None, f"head {i}" if i % 3 else " ", f"tag{i}" if i % 4 else None) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, _SCHEMA)


SIZES = [(2, 3, 4, 2), (None, 3, None, 2), (1, 0, 5, None), (0, 0, 0, 0), None, (None, None, None, None), (7, None, None, None), (None, None, None, 1)]


@pytest.mark.parametrize("cap", [None, 5])
@pytest.mark.parametrize("block", [3, 4096])
def test_rows_equal_the_list(spark, cap, block):
    docs = frame(spark, SIZES)
    args = (F.col("slug"), F.col("tag"))
    got = C.variant_rows(docs, ["id"], F.col("options"), F.col("tiers"), *args, cap=cap, block=block)
    listed = docs.select("id", F.posexplode(V.build_variants(F.col("options"), F.col("tiers"), *args, cap=None)).alias("ordinal", "variant"))
    want = listed.filter(F.col("ordinal") < cap) if cap else listed
    assert sorted((r.id, r.ordinal, r.variant) for r in got.collect()) == sorted((r.id, r.ordinal, r.variant) for r in want.collect())


def test_two_and_a_half_million_combinations_of_one_product(spark):
    docs = frame(spark, [(40, 40, 40, 40)])
    rows = C.variant_rows(docs, ["id"], F.col("options"), F.col("tiers"), F.col("slug"), F.col("tag"))
    assert rows.rdd.getNumPartitions() > 1
    got = rows.agg(F.count("*"), F.min("ordinal"), F.max("ordinal"), F.max(F.length("variant.sku")), F.approx_count_distinct("variant.variant_key", 0.01)).first()
    assert got[:3] == (40**4, 0, 40**4 - 1) and abs(got[4] - 40**4) < 0.05 * 40**4
    one = rows.filter("ordinal = 1234567").first().variant
    a, b, c, d = 1234567 // 64000, 1234567 // 1600 % 40, 1234567 // 40 % 40, 1234567 % 40
    assert [x.option_value_id for x in (one.print_method, one.napkin_color, one.imprint_color, one.ply_or_size)] == [str(x) for x in (a, b, c, d)]


def test_pages_give_the_variants_of_their_documents(spark, sf):
    from querybook.extraction import step_pages
    from shelfdelta.plans import extraction

    pages = step_pages(spark, sf).limit(40)
    listed = extraction.run_site(pages, "customnapkinsnow").filter("outcome = 'scraped'").select("url", F.posexplode("product.variants").alias("ordinal", "variant"))
    rows = extraction.option_step_variants(pages)
    assert sorted((r.url, r.ordinal, r.variant) for r in rows.collect()) == sorted((r.url, r.ordinal, r.variant) for r in listed.collect())


def test_ordered_rows_are_the_same_rows(spark):
    docs, args = frame(spark, SIZES), (F.col("options"), F.col("tiers"), F.col("slug"), F.col("tag"))
    got = C.variant_rows(docs.repartition(2), ["id"], *args, block=3, ordered=["id"])
    want = C.variant_rows(docs, ["id"], *args)
    assert sorted((r.id, r.ordinal, r.variant) for r in got.collect()) == sorted((r.id, r.ordinal, r.variant) for r in want.collect())


def test_variants_are_dealt_out_and_summed_up_unsorted(spark, tmp_path):
    from querybook import tiers

    regions, nations = ["B C", "A"], ["LONGER/NAME", "N", "M"]
    spark.createDataFrame([(r,) for r in regions], "r_name string").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(n,) for n in nations], "n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    parts = [(1, "red ball"), (2, "x/y"), (2, "other"), (3, "red ball")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    summed = tiers.variant_rows_numbered(spark, str(tmp_path))
    plan = summed._jdf.queryExecution().executedPlan().toString().splitlines()
    partial = next(i for i, line in enumerate(plan) if "partial_min" in line)
    join = next(i for i, line in enumerate(plan) if "BroadcastNestedLoopJoin" in line)
    assert partial < join and not any("Sort [" in line for line in plan[partial:join])
    assert any("REPARTITION_BY_NUM" in line for line in plan[join:])
    want = {}
    for key, name in parts:
        for r, n, c in itertools.product(sorted(regions), sorted(nations), sorted(regions, reverse=True)):
            sku = f"{name.replace(' ', '-')}-{key}|print_method:{r}|napkin:{n}|imprint:ink {c}".replace(" ", "-").replace("/", "-")
            want.setdefault(key, []).append((sku, hashlib.sha1(sku.encode()).hexdigest()[:16], 0.25 * (len(n) - 7)))
    assert {r.p_partkey: (r.variants, r.first_key, r.first_sku, r.last_sku, r.sku_137, r.modifiers) for r in summed.collect()} == {
        k: (len(v), min(x[1] for x in v), min(v)[0], max(v)[0], None, sum(x[2] for x in v)) for k, v in want.items()}
