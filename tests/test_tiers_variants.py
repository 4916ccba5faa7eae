import itertools
import json
import statistics

from pyspark.sql import functions as F

from shelfdelta.functions import fixed, text as X
from shelfdelta.operators import tiers as tr, variants as V
from shelfdelta.schemas import OPTION, PRODUCT_DOCUMENT, TIER

TIERS_11 = [(1, 0.01, True), (50, 0.6, False), (100, 0.33, False), (200, 0.32, False), (300, 0.29, False), (500, 0.25, False),
            (1000, 0.23, False), (2000, 0.21, False), (5000, 0.2, False), (10000, 0.19, False), (25000, 0.18, False)]


def tiers():
    return [{"quantity": q, "unit_price": p, "is_sample": s, "is_outlier": False} for q, p, s in TIERS_11]


def documents(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string")
    return df.select(F.from_json("d", PRODUCT_DOCUMENT).alias("p")).select("p.*")


def variant(label, own):
    return {"variant_key": "k" + label, "sku": "s|" + label, "print_method": {"label": label, "option_value_id": "1"},
            "price_modifier_total": 0.5, "tiers": own}


def base(**extra):
    return {"source": "customnapkinsnow", "product_url": "https://h/product/a/b", "schema_version": 2, "name": "N",
            "base_tiers": tiers(), **extra}


def test_variants_with_and_without_their_own_tiers(spark):
    own = documents(spark, base(variants=[variant("A", tiers()), variant("B", tiers())]))
    empty = documents(spark, base(variants=[variant("A", []), variant("B", [])]))
    bare = documents(spark, base(variants=[]))
    for df, rows in ((own, 2), (empty, 2), (bare, 1)):
        size = V.export_size(df).first()
        assert (size.max_tiers, size.total_variants, size.products) == (11, rows, 1)
        out = V.expand_variants(df, 11).collect()
        assert len(out) == rows and out[0]["QtyBreak2"] == "50" and out[0]["Price2"] == "0.6"
        assert out[0]["Source"] == "CUSTOMNAPKINSNOW" and out[0]["Has Pricing"] == "true"
    row = V.expand_variants(bare, 11).first()
    assert row["Variant JSON"] == "{}" and row["Variant Key"] == "" and row["Price Modifier Total"] == ""
    row = V.expand_variants(own, 11).first()
    assert row["Sample Tiers"] == "1" and json.loads(row["Variant JSON"])["tiers"][1]["quantity"] == 50
    assert list(row.asDict())[1:] == fixed.dynamic_columns(11)


def test_old_documents_and_warnings(spark):
    old = documents(spark, {"source": "customnapkinsnow", "product_url": "https://h/p/x y/", "pricing": [
        {"print_method": "Foil/Gold", "quantity": 100, "unit_price": 2}, {"print_method": None, "quantity": 5, "unit_price": 3.5},
        {"print_method": "Foil/Gold", "quantity": 50, "unit_price": 2.5}]})
    out = V.expand_variants(old, 2).collect()
    assert [r["Print Method"] for r in out] == ["Foil/Gold", "Standard"]
    assert (out[0]["QtyBreak1"], out[0]["Price1"], out[0]["Price2"]) == ("50", "2.5", "2")
    assert out[0]["Variant SKU"] == "x y|print_method:Foil-Gold"
    none = V.export_size(documents(spark, base(base_tiers=[], variants=[]))).first()
    assert none.no_tiers and not none.empty_match
    assert V.export_size(documents(spark, base()).filter("false")).first().empty_match


def options(spark, sizes):
    entry = lambda a, i: (f"{a} {i}", str(i), "o", 0.1 * i, None, "")
    value = {a: [entry(a, i) for i in range(n)] for a, n in sizes.items()}
    return spark.createDataFrame([(value, [(10, 1.0, False, False)])], f"o map<string,array<{OPTION}>>, t array<{TIER}>")


def test_variant_matrix_equals_nested_loops(spark):
    for sizes in ({"print_method": 3, "imprint": 2}, {"print_method": 7, "napkin": 9, "imprint": 11},
                  {"napkin": 600, "imprint": 2}, {"print_method": 20, "napkin": 25, "ply_or_size": 3}, {}):
        want = [()]
        for axis in fixed.VARIANT_AXES:
            n = sizes.get(axis, 0)
            if n and len(want) < 500:
                want = [c + (f"{axis}:{axis} {i}",) for c in want for i in range(n)][:500]
        df = options(spark, sizes).select(V.build_variants(F.col("o"), F.col("t"), F.lit("a b"), F.lit(None).cast("string"), 500).alias("v"))
        got = [v.sku for v in df.first().v]
        assert got == ["|".join(("a b",) + c).replace(" ", "-").replace("/", "-") for c in want]
    bare = options(spark, {}).select(V.build_variants(F.col("o"), F.array().cast(f"array<{TIER}>"), F.lit("s"), F.lit("t")).alias("v"))
    assert bare.first().v == []


def test_tier_rules_equal_plain_loops(spark):
    lists = [[(5, 1.0), (3, 2.0), (5, 9.0)], [], [(1, 100.0), (25, 1.0), (50, 0.9), (100, 40.0)], [(1, 5.0), (2, 4.0)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<struct<quantity:bigint,unit_price:double>>")
    out = df.select("i", tr.last_price_wins(F.col("t")).alias("w")).withColumn("f", tr.flagged(F.col("w"))).collect()
    for r in out:
        kept = sorted(dict(lists[r.i]).items())
        assert [tuple(t) for t in r.w] == kept
        bulk = sum(q >= 25 for q, _ in kept) >= 2
        rest = [p for q, p in kept if not (q == 1 and bulk)]
        middle = statistics.median(rest) if rest else 0
        assert [(t.is_sample, t.is_outlier) for t in r.f] == [
            (q == 1 and bulk, middle > 0 and p > 10 * middle) for q, p in kept]


def test_groups_keep_first_seen_order(spark):
    rows = list(itertools.product(["B", "A"], ["2", "1"], [30, 10, 20]))
    df = spark.createDataFrame([([(s, z, q, q / 10) for s, z, q in rows],)],
                               "p array<struct<shape:string,size:string,quantity:bigint,unit_price:double>>")
    groups = df.select(tr.shape_size_groups(F.col("p")).alias("g")).first().g
    assert [(g.group.shape, g.group.size) for g in groups] == [("B", "2"), ("B", "1"), ("A", "2"), ("A", "1")]
    assert all([t.quantity for t in g.tiers] == [10, 20, 30] and g.min_quantity == 10 for g in groups)


def test_variants_and_tiers_are_whole_unless_limited(spark):
    df = options(spark, {"print_method": 5, "napkin": 25, "imprint": 5})
    whole, count = df.select(V.axis_combinations(F.col("o"), F.lit("a")), V.combination_count(F.col("o"))).first()
    assert len({c.sku for c in whole}) == len(whole) == count == 625
    assert len(df.select(V.build_variants(F.col("o"), F.col("t"), F.lit("a"), F.lit("t"), None)).first()[0]) == 625
    price = [(None, None, "m", q, q / 10) for q in range(1, 36)]
    docs = spark.createDataFrame([(price,)], f"pricing {tr.PRICING}")
    for groups in (tr.method_groups, tr.shape_size_groups):
        assert [len(docs.select(groups(F.col("pricing"), *n)).first()[0][0].tiers) for n in ((), (16,))] == [35, 16]


def test_sheet_keeps_tiers_beyond_its_columns(spark):
    from shelfdelta.operators import sheet as S

    price = [(None, None, "m", q, q / 10) for q in range(1, 36)]
    for name in S._GROUPS:
        docs = spark.createDataFrame([(name, "http://u", price)], f"source string, product_url string, pricing {tr.PRICING}")
        rows = S.to_sheet(docs).collect()
        held = [r[f"QtyBreak{i}"] for r in rows for i in range(1, 17)]
        assert len(rows) == 3 and len({r["Variant SKU"] for r in rows}) == 1
        assert sorted(int(q) for q in held if q) == list(range(1, 36))
        assert S.to_sheet(docs, tier_limit=16).count() == 1


def test_long_dimensions_are_kept(spark):
    size = "1" * 25 + " x " + "2" * 25 + " in"
    assert spark.range(1).select(X.dimension_text(F.lit(size)), X.dimension_text(F.lit(size), 39)).first()[:] == (size, None)
