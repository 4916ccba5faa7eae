"""State in key buckets: a run costs what changed, untouched files stay, versions can be read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfdelta.functions import payload as P
from shelfdelta.operators import diff as D, merge as M
from shelfdelta.plans import tracked
from shelfdelta.sources.tables import Store


def ts(n):
    return F.lit(f"2024-01-0{n}").cast("timestamp_ntz")


def docs(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "doc string")


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """All parts stored by a first run of 64 buckets."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows = part.select(F.to_json(F.struct(F.concat(F.lit("p"), "p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                                          F.col("p_retailprice").alias("price"), F.lit("first").alias("scraped_at"))).alias("doc"))
    store = Store(spark, str(tmp_path_factory.mktemp("parts")), n_buckets=64)
    tracked.run(store, "shop", rows, "r1", ts(1))
    return store


def test_a_partial_run_rewrites_the_buckets_of_its_keys(spark, parts):
    before, had = parts.manifest("shop"), {r.product_key: r for r in parts.catalog("shop").collect()}
    old_files = files_below(parts.path("catalog"))
    keys = sorted(had)[:10]
    changed = [{"product_id": k.split(":")[1], "name": "new", "price": 1.5, "scraped_at": "second"} for k in keys[:9]] + [{"product_id": "brand-new"}]
    got = tracked.run(parts, "shop", docs(spark, changed), "r2", ts(2), "t2", partial=True)
    assert got["changes"] == {"added": 1, "updated": 9, "deleted": 0, "unchanged": 0, "soft_deleted": 0}
    after = parts.manifest("shop")
    touched = {b for b, f in after.files.items() if f != before.files.get(b)}
    assert 1 <= len(touched) <= 10 and len(before.files) > 40
    new_files = [f for f in files_below(parts.path("catalog")) if f not in old_files]
    assert len([f for f in new_files if "/index/" in f]) == len(touched) == len([f for f in new_files if "/bodies/" in f])
    # Only the changed payloads were written again.
    assert spark.read.parquet(*{os.path.dirname(f) for f in new_files if "/bodies/" in f}).count() == 10
    now = {r.product_key: r for r in parts.catalog("shop").collect()}
    assert len(now) == len(had) + 1 and all(now[k] == had[k] for k in had if k not in keys)
    assert all(now[k].payload["name"] == '"new"' and now[k].scrape_count == 2 for k in keys[:9])


def test_an_unchanged_run_writes_no_payload_but_new_stamps(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [{"product_id": str(i), "v": i, "scraped_at": "one", "_id": i} for i in range(50)]
    tracked.run(store, "s", docs(spark, rows), "r1", ts(1))
    got = tracked.run(store, "s", docs(spark, [{**r, "scraped_at": "two"} for r in rows]), "r2", ts(2))
    assert got["changes"]["unchanged"] == 50
    assert not [f for f in files_below(store.path("catalog")) if "commit=2" in f and "/bodies/" in f]
    state = store.catalog("s").collect()
    assert {(r.payload["scraped_at"], r.payload["_id"] == r.payload["v"], r.scrape_count) for r in state} == {('"two"', True, 2)}


def test_payloads_of_unchanged_keys_are_not_exchanged(spark, tmp_path, monkeypatch):
    store, staged = Store(spark, str(tmp_path)), []
    rows = [{"product_id": str(i), "v": i} for i in range(300)]
    tracked.run(store, "s", docs(spark, rows), "r1", ts(1))
    real = tracked.cut_lineage

    def watched(df, name):
        out = real(df, name)
        staged.append((name.split("-")[0], df._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(tracked, "cut_lineage", watched)
    source = spark.read.text(str(_written(docs(spark, [{**r, "v": -1} if r["product_id"] == "7" else r for r in rows] * 2), tmp_path)))
    tracked.run(store, "s", source.withColumnRenamed("value", "doc"), "r2", ts(2))
    by_name = {name: (plan, out) for name, plan, out in staged}
    assert "payload" not in by_name["keys"][1].columns + by_name["decided"][1].columns
    # Copies of a key meet with hashes and stamps, keys of both sides without any payload in the plan.
    copies = [line for line in by_name["keys"][0].split("\n") if "partial_max_by" in line]
    assert copies and not any("payload#" in line for line in copies)
    assert "Exchange" in by_name["decided"][0] and "payload#" not in by_name["decided"][0]
    assert [(r.product_key, r.change_type) for r in by_name["changed"][1].collect()] == [("s:7", "updated")]


def _written(df, tmp_path):
    df.write.text(str(tmp_path / "incoming"))
    return tmp_path / "incoming"


def test_lookup_reads_one_bucket(spark, parts):
    key = sorted(r.product_key for r in parts.catalog("shop", ["product_key"]).collect())[20]
    found = parts.lookup([key], "shop")
    assert [r.product_key for r in found.collect()] == [key]
    assert len(found.inputFiles()) <= 4 < len(parts.catalog("shop").inputFiles())
    assert parts.lookup(["shop:none"], "shop").count() == 0
    assert parts.lookup([], "shop").count() == 0


def test_columns_without_payload_read_no_payload_file(parts):
    files = parts.catalog("shop", ["product_key", "data_hash", "deleted_at"]).inputFiles()
    assert files and all("/index/" in f for f in files)


def test_compaction_keeps_the_state_and_old_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path), n_buckets=2)
    rows = [{"product_id": str(i), "v": 0, "w": i} for i in range(20)]
    tracked.run(store, "s", docs(spark, rows), "r1", ts(1))
    for n in range(2, 5):
        tracked.run(store, "s", docs(spark, [{"product_id": str(i), "v": n} for i in range(10)]), f"r{n}", ts(n), partial=True)
    state = sorted(store.catalog("s").collect())
    assert max(len(f.bodies) for f in store.manifest("s").files.values()) == 4
    assert store.compact("s", ts(5), most_files=2) == 2 and store.compact("s", ts(5), most_files=2) == 0
    assert sorted(store.catalog("s").collect()) == state
    assert all(len(f.bodies) == 1 and f.n_bodies == f.n_rows for f in store.manifest("s").files.values())
    # Fields that a later document lacks stay; an older commit still reads as it was.
    assert all(r.payload["w"] is not None for r in state)
    old = store.index([store.manifest("s", 1)])
    assert old.count() == 20 and old.agg(F.max("scrape_count")).first()[0] == 1
    assert tracked.run(store, "s", docs(spark, [{"product_id": "3", "v": 4}]), "r6", ts(6), partial=True)["changes"]["unchanged"] == 1


def test_snapshots_are_references(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": str(i)} for i in range(5)]), "r1", ts(1))
    tracked.run(store, "s", docs(spark, [{"product_id": "1"}, {"product_id": "9"}]), "r2", ts(2), partial=True)
    count = {(r.run_id, r.snapshot_type): r["count"] for r in store.read("snapshots").groupBy("run_id", "snapshot_type").count().collect()}
    assert count == {("r1", "post_scrape"): 5, ("r2", "pre_scrape"): 5, ("r2", "post_scrape"): 2}
    assert not files_below(store.path("snapshots"))
    one = store.snapshots("r2", "post_scrape").collect()
    assert {r.product_key for r in one} == {"s:1", "s:9"} and {str(r.created_at) for r in one} == {"2024-01-02 00:00:00"}


def test_decisions_equal_the_payload_join(spark, sf):
    """The narrow decision and the join of whole rows agree on every key of two runs."""
    from querybook.derived import batch, state
    old = state(spark, sf).filter("source = 'shop-1'")
    new = batch(spark, sf).filter("source = 'shop-1'")
    index = old.withColumn("stamps", P.stamps(F.col("payload"))).withColumn("written", F.lit(1)).withColumn("seen_in", F.lit(1))
    for partial in (False, True):
        shown = ["product_key", "change_type", "data_hash", "created_at", "updated_at", "deleted_at", "deleted_by_task", "last_task_id", "scrape_count", "revived", "active"]
        narrow = M.decide(index, tracked.winners(new), ts(3), 2, "t", partial).select(*shown)
        whole = M.apply_run(old, new, ts(3), "t", partial).select(*shown)
        assert narrow.exceptAll(whole).count() == whole.exceptAll(narrow).count() == 0 and whole.count() > 10


def test_copies_of_a_key_and_a_hidden_field(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 1, "seen": 1}, {"product_id": "a", "v": 1, "seen": 2}]), "r1", ts(1), hidden=["seen"])
    again = tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 1, "seen": 3}]), "r2", ts(2), hidden=["seen"])
    assert again["changes"]["unchanged"] == 1 and store.catalog("s").first().payload["seen"] == "3"
    # A field that is hidden no longer counts again.
    third = tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 1, "seen": 4}]), "r3", ts(3), hidden=[])
    assert third["changes"]["updated"] == 1 and store.catalog("s").first().payload["seen"] == "4"
    # Nor is a field lost that was hidden before and is missing now.
    tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 2, "seen": 5}]), "r4", ts(4), hidden=["seen"])
    tracked.run(store, "s", docs(spark, [{"product_id": "a", "v": 3}]), "r5", ts(5), hidden=[])
    assert {k: store.catalog("s").first().payload[k] for k in ("v", "seen")} == {"v": "3", "seen": "5"}


def test_sweep_keeps_the_last_commits_and_their_readers(spark, tmp_path):
    store = Store(spark, str(tmp_path), n_buckets=4)
    tracked.run(store, "s", docs(spark, [{"product_id": str(i), "v": 0} for i in range(40)]), "r1", ts(1))
    for n in range(2, 6):
        tracked.run(store, "s", docs(spark, [{"product_id": "3", "v": n}]), f"r{n}", ts(n), partial=True)
    state, files = sorted(store.catalog("s").collect()), files_below(store.path("catalog"))
    reader = store._joined([store.manifest("s", 4)])  # of the commit before the last
    os.makedirs(f"{store.path('catalog')}/source=s/commit=3-died/index/bucket=0")
    assert store.sweep("s", keep=2) > 0 and store.sweep("s", keep=2) == 0
    assert len(files_below(store.path("catalog"))) < len(files) and not os.path.exists(f"{store.path('catalog')}/source=s/commit=3-died")
    assert sorted(store.catalog("s").collect()) == state
    assert {r.product_key: r.payload["v"] for r in reader.collect()}["s:3"] == "4"
    kept = {(r.run_id, r.snapshot_type) for r in store.read("snapshots").collect()}
    assert kept == {("r4", "post_scrape"), ("r5", "pre_scrape"), ("r5", "post_scrape")}
    assert tracked.run(store, "s", docs(spark, [{"product_id": "3", "v": 5}]), "r6", ts(6), partial=True)["changes"]["unchanged"] == 1


def test_old_staging_goes(spark):
    from shelfdelta.session import cut_lineage, shared_dir, sweep_staging

    cut_lineage(spark.range(3), "sweep-me").count()
    names = lambda: [n for n in os.listdir(f"{shared_dir(spark)}/shelfdelta") if n.startswith("sweep-me")]
    assert sweep_staging(spark, 24) == 0 and names()
