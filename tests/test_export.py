from pyspark.sql import functions as F

from shelfdelta.functions import fixed
from shelfdelta.operators import sheet as S
from shelfdelta.plans import export
from shelfdelta.sources import csv_files, envelope as E


def products(spark):
    rows = [("shop", f"p{i}", f'Name "{i}", x\ny', 1000 + i, True, None) for i in range(4)] + [
        ("shop", "dead-Y", "Dead", 5, True, "2024-01-01")]
    return spark.createDataFrame(rows, "source string, product_id string, title string, price_cents long, available boolean, "
                                       "d string").select("*", F.col("d").cast("timestamp_ntz").alias("deleted_at"),
                                                          F.lit("2024-02-01").cast("timestamp_ntz").alias("updated_at"))


def test_tombstones_never_leave(spark, tmp_path):
    path = str(tmp_path / "out")
    export.products_csv(products(spark), path, " SHOP ", start="2024-02-01", end="2024-02-01")
    back = csv_files.read(spark, path, fixed.sheet_columns())
    assert back.count() == 4 and back.filter("`Supplier SKU` = 'dead-Y'").count() == 0
    assert sorted(r["Product Name"] for r in back.collect())[0] == 'Name "0", x\ny'
    assert export.selected(products(spark), "shop", start="2024-02-02").count() == 0
    export.products_csv(products(spark), str(tmp_path / "split"), rows_per_file=2)
    assert csv_files.read(spark, str(tmp_path / "split"), fixed.sheet_columns()).count() == 4


def test_blueprint_export_is_sorted_and_filtered(spark, tmp_path):
    df = products(spark).withColumn("source", F.lit("printify")).withColumn(
        "blueprint_id", (10 - F.col("price_cents") % 10).cast("bigint")).withColumn("provider_id", F.lit(1).cast("bigint"))
    export.blueprint_csv(df, str(tmp_path / "b"), provider_id=1)
    rows = csv_files.read(spark, str(tmp_path / "b"), fixed.sheet_columns()).collect()
    assert sorted(r["Supplier SKU"] for r in rows) == ["BP10", "BP7", "BP8", "BP9"]
    assert {r["Price1"] for r in rows} == {"10.0", "10.01", "10.02", "10.03"} and {r["Active"] for r in rows} == {"Yes"}


def test_column_lists(spark):
    assert len(export.column_list(products(spark), "shop")) == 206
    assert export.column_list(products(spark), "shop", "House SKU")[0] == "House SKU"


def test_own_source_map(spark):
    S.register_source("myshop", {"Source": S.constant("MINE"), "Product Name": S.field("missing", "title")})
    row = S.to_sheet(products(spark).withColumn("source", F.lit("MyShop"))).first()
    assert row["Source"] == "MINE" and row["Product Name"].startswith("Name") and row["Active"] == ""


def test_result_envelopes_to_rows(spark):
    rows = [("shop", '{"products":[{"sku":"a","name":"A"},{"sku":"b","title":"B"}]}'), ("shop", '{"products":[],"suppliers":[{"sku":"c"}]}'),
            ("other", '{"sku":"d","name":"D"}'), ("shop", '[{"sku":"e"}]'), ("shop", '"text"'), ("shop", "broken")]
    df = spark.createDataFrame(rows, "site string, data string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = export.result_rows(df).collect()
    assert sorted((r["Source"], r["Supplier SKU"]) for r in out) == [
        ("OTHER", "d"), ("SHOP", "a"), ("SHOP", "b"), ("SHOP", "c"), ("SHOP", "e")]
    assert export.result_rows(df, "Other").count() == 1
    kept = E.explode_products(df, E.storage_products(F.col("data"))).collect()
    assert sorted(r.doc for r in kept) == ['{"name":"A","sku":"a"}', '{"name":"D","sku":"d"}', '{"sku":"b","title":"B"}', '{"sku":"e"}']


def test_rows_in_are_rows_out_and_every_problem_is_named(spark, tmp_path):
    docs = ['{"product_id":"a","price_cents":"12","base_tiers":[{"quantity":5,"unit_price":1}]}', '{"product_id":"b","price_cents":" ","available":null}',
            '{"product_id":"c","price_cents":"1,5","base_tiers":[{"quantity":null,"unit_price":-1}],"images":"x"}', "[1]", "broken", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, doc string")
    counts = export.write_by_outcome(export.checked_sheet(rows, "printify", keep=["id"]), str(tmp_path / "out"))
    assert counts == {"rows": 6, "bad": 4, "problems": 7, "good": 2}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and {r.id for r in back.filter("outcome = 'good'").collect()} == {0, 1}
    assert sorted((r.id, r.column, r.reason) for r in export.error_rows(back, ["id"]).collect()) == [
        (2, "base_tiers", "price"), (2, "base_tiers", "quantity"), (2, "images", "other shape"), (2, "price_cents", "no bigint"),
        (3, "document", "no JSON object"), (4, "document", "no JSON object"), (5, "document", "no JSON object")]
