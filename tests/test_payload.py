import json

from pyspark.sql import functions as F

from shelfdelta.functions import payload as P


def parsed(spark, *documents):
    return spark.createDataFrame([(d,) for d in documents], "doc string").select(P.parse(F.col("doc")).alias("p"))


def test_missing_null_and_types_stay_apart(spark):
    rows = parsed(spark, '{"a":null,"n":1,"s":"1","o":{"z":1,"a":[2,1]}}', "not json").collect()
    assert rows[0].p == {"a": "null", "n": "1", "s": '"1"', "o": '{"a":[2,1],"z":1}'}
    assert rows[1].p is None


def test_hash_ignores_key_order_and_storage_fields(spark):
    hashes = parsed(spark, '{"a":1,"b":{"x":1,"y":2}}', '{"b":{"y":2,"x":1},"a":1,"updated_at":"t","scraped_at":"u"}',
                    '{"a":"1","b":{"x":1,"y":2}}').select(P.content_hash(F.col("p")).alias("h")).collect()
    assert hashes[0].h == hashes[1].h != hashes[2].h and len(hashes[0].h) == 32


def test_applying_a_diff_to_the_old_gives_the_new(spark):
    cases = [({"a": 1, "b": "x"}, {"a": 1, "b": "y", "c": [1]}), ({"a": None}, {}), ({}, {"q": {"k": "v"}}),
             ({"same": True}, {"same": True}), ({"a": 1}, {"a": "1"})]
    rows = spark.createDataFrame([(json.dumps(o), json.dumps(n)) for o, n in cases], "o string, n string").select(
        P.parse(F.col("o")).alias("o"), P.parse(F.col("n")).alias("n")).withColumn("d", P.diff(F.col("o"), F.col("n")))
    for r in rows.collect():
        applied = {k: v for k, v in r.o.items() if k not in r.d.removed_fields}
        applied.update(r.d.added_fields)
        applied.update({k: c.new_value for k, c in r.d.changed_fields.items()})
        assert applied == r.n
        assert all(r.o[k] == c.old_value != c.new_value for k, c in r.d.changed_fields.items())


def test_caps_on_records_and_single_values(spark):
    big = "x" * 3000
    df = spark.createDataFrame([(json.dumps({"a": big, "b": "s"}), json.dumps({"a": big + "y", "b": "t"}))], "o string, n string")
    row = df.select(P.parse(F.col("o")).alias("o"), P.parse(F.col("n")).alias("n")).select(
        P.cap(F.col("o"), 1000).alias("capped"), P.cap(F.col("o"), 10000).alias("kept"),
        P.cap_diff(P.diff(F.col("o"), F.col("n")), 1000).alias("d")).first()
    assert row.capped == {"payload_truncated": "true", "size_bytes": str(len('{"a":"","b":"s"}') + 3000)}
    assert row.kept["b"] == '"s"'
    assert json.loads(row.d.changed_fields["a"].old_value) == {"payload_truncated": True, "size_bytes": 3002}
    assert row.d.changed_fields["b"].new_value == '"t"'


def test_oversize_envelope_keeps_its_outline(spark):
    data = json.dumps({"products": [{"n": "x" * 100}] * 50, "stats": {"found": 50}, "site": "s"})
    df = spark.createDataFrame([(data,)], "data string")
    cut, kept = df.select(P.cap_envelope(F.col("data"), 1000), P.cap_envelope(F.col("data"), 10**6)).first()
    out = json.loads(cut)
    assert kept == data and out["truncated"] is True and out["products_count"] == 50
    assert out["stats"] == {"found": 50} and out["original_keys"] == ["products", "stats", "site"]
    assert out["original_size_bytes"] == len(data)


def test_change_log_texts(spark):
    df = parsed(spark, '{"b":"x → y","a":true,"n":null,"l":[1,"q"]}')
    assert df.select(P.fields_text(F.col("p"))).first()[0] == 'a: True; b: x → y; l: [1,"q"]; n: None'
