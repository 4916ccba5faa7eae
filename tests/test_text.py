import random

from pyspark.sql import functions as F

from shelfdelta.functions import text as X, urls as U


def test_number_texts_equal_python(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, 0.6, 0.33, 1e-5, 1.5e-5, 0.0001, 0.00025, 0.001, 13.85, 50.0, 1e7, 12345678.9, 1e15, 123456789012.25,
              -2.5, 1e16, 2.5e20] + [round(rng.uniform(0, 10 ** rng.randint(0, 9)), rng.randint(0, 4)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, shown, price in df.select("v", X.float_text(F.col("v")), X.price_text(F.col("v"))).collect():
        assert float(shown) == v
        assert price == (str(int(v)) if v.is_integer() else shown)
        if v < 1e10:  # the JVM's digits of larger values may be longer than the shortest
            assert shown == repr(v)


def test_cells_and_money(spark):
    row = spark.createDataFrame([(1385, 0, None, " $1,234.5 ", "abc", ["a", "", None, "b"])],
                                "a long, z long, n long, m string, bad string, l array<string>").select(
        X.cents_text(F.col("a")), X.cents_text(F.col("z")), X.cents_text(F.col("n")), X.cents_amount(F.col("z")),
        X.money(F.col("m")), X.money(F.col("bad")), X.join_list(F.col("l")), X.quantity_text(F.col("bad")),
        X.quantity_text(F.col("n"))).first()
    assert tuple(row) == ("13.85", "0.0", "", None, 1234.5, 0.0, "a|b", "abc", "")


def test_texts_of_pages(spark):
    df = spark.createDataFrame([("Mug\nA very nice mug for every single day\nSPECIFICATIONS\nx", "Mug")], "t string, n string")
    out = df.select(X.clean_description(F.col("t"), F.col("n")), X.dimension_text(F.lit("about 4.5 x 6 in wide")),
                    X.labelled_line(F.lit("Size: 3\nmaterial :  Oak \nx"), "Material"),
                    X.colour_list(F.lit("Red, Blue • Red / Green")), X.option_group(F.lit("Step 2: Foil Color"))).first()
    assert tuple(out) == ("A very nice mug for every single day", "4.5 x 6 in", "Oak", ["Red", "Blue", "Green"], "imprint")


def test_url_rules(spark):
    base = "https://a.b/x/y?q=1"
    links = {"/p": "https://a.b/p", "z": "https://a.b/x/z", "//c.d/e": "https://c.d/e", "http://q/": "http://q/",
             "?r=2": "https://a.b/x/y?r=2", "#t": "https://a.b/x/y?q=1#t"}
    df = spark.createDataFrame([(k,) for k in links], "l string")
    for link, url in df.select("l", U.resolve(F.col("l"), F.lit(base))).collect():
        assert url == links[link]
    urls = {"https://a.b/": "https://a.b/", "https://a.b": "https://a.b", "https://a.b/c/d//?x": "https://a.b/c/d",
            "https://a.b/c#f": "https://a.b/c"}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    for url, want in df.select("u", U.canonical(F.col("u"))).collect():
        assert want == urls[url]
    flags = spark.createDataFrame([("https://h/product/a/b",), ("https://h/product/a",), ("https://h/product/page/b/c",),
                                   ("https://x/product/a/b",)], "u string").select(
        U.is_product(F.col("u"), "https://h"), U.is_category_root(F.col("u"), "https://h")).collect()
    assert [tuple(f) for f in flags] == [(True, False), (False, True), (False, False), (False, False)]
