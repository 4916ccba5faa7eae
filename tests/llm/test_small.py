"""Archive, fingerprints, quality, language and URL verdicts on small and odd inputs."""

import math

import pytest
from pyspark.sql import functions as F

from shelfdelta.llm import ecoc_langid, fingerprints, link_trust, quality_table, warc_store
from shelfdelta.session import staging_path


def test_archive_restores_odd_pages(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (2, None, "x"), (3, "http://b\r\n/", None), (4, "c", ""), (None, "d", "x"), (None, "e", "only")]
    path = staging_path(spark, "warc-test")
    warc_store.ingest(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    back = warc_store.restore(spark, path).select("record_id", F.decode("payload", "UTF-8"), warc_store.header_field("WARC-Type")).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in back) == [
        (0, "only", "response"), (0, "x", "revisit"), (1, "x", "revisit"), (2, "x", "response"), (2, "x", "response"), (3, "", "revisit"), (4, "", "response")]


def test_hot_payloads_and_joins_without_an_exchange(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "hot" if i % 3 else f"page {i}") for i in range(60)] + [(None, "n", "hot"), (0, "again", "page 0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc_store, "_hot_from", lambda n: 10)
    shown = []
    for hot in (True, False):
        if not hot:
            monkeypatch.setattr(warc_store, "_hot_from", lambda n: 1000)
        path = staging_path(spark, "warc-test")
        warc_store.ingest(pages, path)
        back = warc_store.restore(spark, path)
        if not hot:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = warc_store.restore(spark, path)._jdf.queryExecution().executedPlan().toString()
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        shown.append(sorted((r[0] if r[0] is not None else -1, bytes(r[1]), r[2]) for r in back.select("record_id", "header", F.decode("payload", "UTF-8")).collect()))
        assert spark.read.parquet(*[f"{path}/{n}" for n in (("payloads", "hot-payloads") if hot else ("payloads",))]).count() == 21
    assert shown[0] == shown[1] and [r[2] for r in shown[0]] == [h for _, h in sorted(((i if i is not None else -1), h) for i, _, h in rows)]
    assert sum(b"WARC-Type: response" in r[1] for r in shown[0]) == 22


def test_empty_archive(spark):
    path = staging_path(spark, "warc-test")
    warc_store.ingest(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.restore(spark, path).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_fingerprints_pair_neighbours(request, which):
    docs = request.getfixturevalue(which)
    got = sorted((r["doc_id"] or -1, r["n_chars"], r["fingerprint"]) for r in fingerprints.with_neighbours(docs).collect())
    assert got == sorted((r["doc_id"] or -1, len(r["text"] or ""), fingerprints.fingerprint(r["text"] or "")) for r in docs.collect())


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_quality_and_language_keep_rows(request, documents, which):
    docs = request.getfixturevalue(which)
    assert quality_table.measured(docs).count() == docs.count()
    out = ecoc_langid.predict(docs, ecoc_langid.train(documents))
    assert out.columns[:6] == docs.columns and out.count() == docs.count()
    assert {r["lang_pred"] for r in out.where("text is null or doc_id in (2, 6)").collect()} <= {"und"}


@pytest.fixture(scope="module")
def language_model(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return docs, held_out, ecoc_langid.train(docs, ~held_out)


def test_held_out_languages_with_scores(language_model):
    docs, held_out, model = language_model
    rows = ecoc_langid.predict(docs.where(held_out), model).collect()
    told = [r for r in rows if r["text"] and ecoc_langid.has_letter(r["text"])]
    assert len(told) > 200 and sum(r["lang_pred"] == r["lang"] for r in told) >= 0.99 * len(told)
    assert sum(not r["lang_ambiguous"] for r in told) >= 0.98 * len(told)
    assert sorted(r["lang_score"] for r in told)[len(told) // 2] > 0.9 and len({r["lang_score"] for r in told}) > 50


def test_mixed_unseen_and_gibberish_are_flagged(spark, language_model):
    docs, _, model = language_model
    some = {r["lang"]: r["text"][:800] for r in docs.where("length(text) > 1500 and text not like '%###%' and text not like '%|%'").collect()}
    texts = [some["en"] + " " + some["fr"], some["de"] + " " + some["es"], "zzz qqq xxx kkk", "这是一个中文句子，没有其他语言。", "Привет мир как дела", some["en"], some["es"]]
    got = ecoc_langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_ambiguous"] for r in got] == [True] * 5 + [False] * 2
    assert max(r["lang_score"] for r in got[:5]) < 0.6 < 0.8 < min(r["lang_score"] for r in got[5:])
    assert [r["lang_pred"] for r in got[5:]] == ["en", "es"]


def test_decoding_as_written_out(language_model):
    _, _, model = language_model
    bits = range(model.codes.shape[1])
    for text in ("the house is on the hill", "la casa es de los dos", "ein Haus auf dem Berg und", "x"):
        at = ecoc_langid.grams(text)
        mean = [sum(model.weights[g][b] for g in at) / len(at) for b in bits]
        losses, agreed = [], []
        for i in range(len(model.languages)):
            losses.append(sum(model.trust[i][b] * math.exp(-model.codes[i][b] * math.tanh(8 * mean[b])) for b in bits))
            agreed.append(sum(model.codes[i][b] * mean[b] for b in bits) / len(bits) / model.typical[i])
        best = losses.index(min(losses))
        lead = agreed[best] - max(a for i, a in enumerate(agreed) if i != best)
        assert ecoc_langid.decode(model, ecoc_langid.evidence(model, text)) == pytest.approx((best, min(1, max(0, (agreed[best] + lead) / 2)), agreed[best], lead))


def test_url_rules(spark):
    urls = ["http://X.Net/a", "https://www.example.net/en/x?q", "http://example.com/de/1", "http://example.com/de", None, "no url", "http://a.org/fr/#x"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in link_trust.judge(pages).collect()}
    assert got == {0: ("x.net", "/a", "net/"), 1: ("www.example.net", "/en/x", "example.net/en/"), 2: ("example.com", "/de/1", "example.com/de/"),
                   3: ("example.com", "/de", None), 4: ("", "", None), 5: ("", "", None), 6: ("a.org", "/fr/", "org/fr/")}


def test_hosts_without_a_rule_are_blocked_through_the_graph(spark):
    link = '<a href="http://{}/">x</a>'.format
    rows = [(1, "http://bad.net/", None), (2, "http://b.com/", link("bad.net")), (3, "http://c.com/", link("b.com")), (4, "http://d.com/", None),
            (5, "http://e.org/fr/", link("f.com")), (6, "http://f.com/", link("bad.net")), (7, "http://g.com/", link("d.com"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in link_trust.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_half_blocked_host_without_edges_is_blocked(spark):
    urls = [f"http://{h}.example.com/{p}/" for h, paths in (("half", "de fr"), ("fifth", "de a b c d")) for p in paths.split()]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in link_trust.judge(pages).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_spread_goes_on_to_the_limit(spark):
    ring = spark.createDataFrame([(str(i), str((i + 1) % 12), 1.0) for i in range(12)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("trust", "0", 1.0)], "kind string, host string, seed double")
    got = {int(r["host"]): r["score"] for r in link_trust.spread(seeds, ring, 0.85, 0.01).collect()}
    limit = {i: 0.15 * 0.85 ** i / (1 - 0.85 ** 12) for i in range(12)}
    assert got.keys() == limit.keys() and all(0 <= limit[i] - got[i] < 0.01 for i in limit)


def test_one_repeated_line_of_three_counts(spark, tmp_path):
    from shelfdelta.llm import queries

    line = " ".join(f"w{i}" if i % 10 else "the" for i in range(80))
    rows = [(1, "\n".join([line, "next", "next"])), (2, "\n".join([line, "next", "last"])),
            (3, "\n".join([line, "next", "next", "last", "last"])), (4, "\n".join([line, "next", "next", "last"])), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    judged = {r["doc_id"]: (r["n_dup_lines"], r["base_failed"], r["kept"]) for r in queries.QUERIES["op5_quality_table"](spark, str(tmp_path)).collect()}
    assert judged == {1: (1, False, False), 2: (0, False, True), 3: (2, False, False), 4: (1, False, True), 5: (0, True, False)}
