"""Headline queries, timed once each after a warm-up; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "change_classify", "change_stats_by_source", "field_diff", "audit_log_text", "catalog_merge", "run_counters",
    "batch_last_wins", "tier_pivot_16", "variant_rows_outer", "product_rows_expanded", "provider_allowlist_fanout",
    "catalog_stats", "min_shipping_fallback", "link_precedence_union", "lastmod_skip", "status_apply_guarded",
    "lifecycle_fold", "keep_last_100", "admission_guard", "page_links", "text_spec_extract", "audit_payload_cap",
    "html_price_tables", "option_step_products", "envelope_products",
]


def main() -> None:
    import querybook
    from shelfdelta.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    querybook.load_all()
    # The JVM and the code cache warm up on the two kinds of plan there are most of.
    for name in ("change_stats_by_source", "tier_rows"):
        querybook.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        began = time.perf_counter()
        querybook.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "catalog_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
