import json

import pytest
from pyspark.sql import functions as F

from shelfdelta.plans import tracked
from shelfdelta.sources.tables import Store, latest_sessions

TS = "2024-01-0{}"


def ts(n):
    return F.lit(TS.format(n)).cast("timestamp_ntz")


def docs(spark, rows):
    return spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(rows)], "doc string, seq long")


def product(i, modified=False):
    return {"source": "SHOP", "product_id": f"p-{i}", "name": f"Product {i}", "category": "c",
            "price_cents": 1599 if modified else 1000, "available": not modified,
            "variants": [{"sku": f"s{i}", "qty": 2}], "tags": ["a", "b"] + (["c"] if modified else [])}


def changes(result):
    return tuple(result["changes"][k] for k in ("added", "updated", "deleted", "unchanged"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store(spark, str(tmp_path_factory.mktemp("store")))


def test_three_passes_and_a_partial_run(spark, store):
    first = tracked.run(store, " Shop ", docs(spark, [product(i) for i in range(1200)]), "r1", ts(1), "t1")
    assert changes(first) == (1200, 0, 0, 0)
    second = tracked.run(store, "shop", docs(spark, [product(i, i < 100) for i in range(1300) if not 100 <= i < 200]),
                         "r2", ts(2), "t2")
    assert changes(second) == (100, 100, 100, 1000)
    assert second["storage"] == {"inserted": 100, "updated": 1100, "failed": 0}

    log = store.read("changes").filter("task_id = 't2'")
    updated = log.filter("change_type = 'updated'").first()
    assert set(updated.field_changes.changed_fields) == {"price_cents", "available", "tags"}
    assert updated.field_changes.changed_fields["price_cents"].asDict() == {"old_value": "1000", "new_value": "1599"}
    deleted = log.filter("change_type = 'deleted'").first()
    assert deleted.new_data is None and deleted.old_data["name"].startswith('"Product 1')
    assert store.catalog("shop").filter("deleted_at is not null and deleted_by_task = 't2'").count() == 100

    third = tracked.run(store, "shop", docs(spark, [product(150)]), "r3", ts(3), "t3", partial=True)
    assert changes(third) == (0, 0, 0, 1) and third["revived"] == 1 and third["is_partial"]
    row = store.catalog("shop").filter("product_key = 'shop:p-150'").first()
    assert row.deleted_at is None and row.scrape_count == 2 and row.last_task_id == "t3"
    assert store.catalog("shop").filter("deleted_at is null").count() == 1201
    assert store.read("changes").filter("task_id = 't3'").count() == 0

    sessions = {r.session_id: r for r in latest_sessions(store.read("sessions")).collect()}
    assert sessions["r2"].status == "completed" and sessions["r2"].products_stored == 1200
    assert sessions["r3"].scrape_type == "partial"


def test_repeating_a_run_after_a_crash_before_its_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [product(1)]), "r1", ts(1))
    # A state folder without a commit is what a crashed run leaves behind.
    store.catalog("s").write.parquet(f"{store.path('catalog')}/source=s/run=r2")
    assert store.catalog("s").count() == 1
    again = tracked.run(store, "s", docs(spark, [product(1), product(2)]), "r2", ts(2))
    assert changes(again) == (1, 0, 0, 1) and store.catalog("s").count() == 2


def test_copies_key_order_and_identity(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [{"product_id": "a", "n": 1}, {"sku": "b", "product_id": ""}, {"product_url": "u"}, {"name": "only name"},
            {"product_id": "a", "n": 2}]
    first = tracked.run(store, "s", docs(spark, rows), "r1", ts(1), order=["seq"])
    assert changes(first) == (4, 0, 0, 0)
    state = {r.product_key: r.payload for r in store.catalog("s").collect()}
    assert state["s:a"]["n"] == "2" and {"s:b", "s:u"} < set(state)
    # Other key order, an added crawl stamp and storage fields change nothing.
    same = [{"n": 2, "product_id": "a", "scraped_at": "now", "updated_at": "x"}] + rows[1:4]
    assert changes(tracked.run(store, "s", docs(spark, same), "r2", ts(2), order=["seq"])) == (0, 0, 0, 4)


def test_two_sources_do_not_touch_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "one", docs(spark, [product(1)]), "r1", ts(1))
    tracked.run(store, "two", docs(spark, [product(2)]), "r2", ts(2))
    assert store.catalog().count() == 2 and store.catalog("one").count() == 1


def test_a_run_that_dies_before_its_commit_leaves_no_second_records(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    tracked.run(store, "s", docs(spark, [product(1), product(2)]), "r1", ts(1))
    real = Store.write_catalog

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "write_catalog", dies)
    with pytest.raises(RuntimeError):
        tracked.run(store, "s", docs(spark, [product(1, True), product(3)]), "r2", ts(2))
    monkeypatch.setattr(Store, "write_catalog", real)
    assert store.catalog("s").filter("product_key = 's:p-3'").count() == 0
    again = tracked.run(store, "s", docs(spark, [product(1, True), product(3)]), "r2", ts(2))
    assert changes(again) == (1, 1, 1, 0)
    kinds = [r.change_type for r in store.read("changes").filter("session_id = 'r2'").collect()]
    assert sorted(kinds) == ["added", "deleted", "updated"]
    assert store.read("changes").filter("session_id = 'r1'").count() == 2
    assert store.read("snapshots").filter("run_id = 'r2' and snapshot_type = 'pre_scrape'").count() == 2
