"""Each stage of the pipeline on its own input, and the whole run, against plain versions."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from llm import brute

CLASHES = {"lang_pred": 7, "lang_score": "x", "_measure": 1, "n_removed": 2, "n_words": "w", "kept_text": "k", "class_id": 3, "text_id": 4, "links": 5,
           "stay": 6, "own0": 8, "digest": 9, "source_sha256": "s", "lang_ambiguous": "a"}
FILTERS = [f for n, f in P.STAGES[:-1]]


@pytest.fixture(scope="module")
def clashing(odd_documents):
    return odd_documents.select("*", *[F.lit(v).alias(c) for c, v in CLASHES.items()])


@pytest.mark.parametrize("stage", FILTERS, ids=[n for n, _ in P.STAGES[:-1]])
def test_stages_hold_odd_rows_and_clashing_names(spark, sf, clashing, stage):
    out = stage(spark, clashing, sf)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in clashing.schema]
    rows = out.collect()
    assert all(r[c] == v for r in rows for c, v in CLASHES.items())
    empty = stage(spark, clashing.limit(0), sf)
    assert empty.columns == clashing.columns and empty.count() == 0


def test_packing_of_odd_rows(spark, sf, clashing):
    pieces = P.packing(spark, clashing, sf)
    assert pieces.count() > 0 and P.packing(spark, clashing.limit(0), sf).count() == 0


def test_language_keeps_told_texts(spark, sf, documents):
    kept = {r["doc_id"] for r in P.language(spark, documents, sf).collect()}
    plain = [r for r in documents.collect() if len(re.findall("[^\\W\\d_]+", r["text"] or "")) >= 30]
    assert sum(r["doc_id"] in kept for r in plain) >= 0.97 * len(plain)


def test_quality_equals_the_plain_rules(spark, sf, documents):
    from shelfdelta.llm.quality_table import STOP_WORDS

    def good(text):
        words = brute.WORD.findall(text)
        lines = [x for x in text.split("\n") if brute.WORD.search(x)]
        seen, covered = {}, set()
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i:i + 3]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered.update(x for i in at for x in (i, i + 1, i + 2))
        n = len(words)
        return (n >= 50 and 2 <= sum(map(len, words)) / n <= 25 and sum(c in "#*$%&|<>" for c in text) <= 0.1 * n
                and sum(w.lower() in STOP_WORDS for w in words) >= 0.02 * n and (len(lines) - len(set(lines)) < 3 or len(lines) - len(set(lines)) <= 0.3 * len(lines))
                and len(covered) <= 0.5 * n)

    assert {r["doc_id"] for r in P.quality(spark, documents, sf).collect()} == {r["doc_id"] for r in documents.collect() if good(r["text"] or "")}


def test_near_duplicates_keep_the_least_id(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {d for d, (c, _) in brute.near_classes(rows).items() if d == c}
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, documents, sf).collect()) == sorted(want)


def test_repeated_ids_keep_one_row_by_a_rule(spark, sf):
    rows = [(1, f"text {x} of one id", x) for x in "cab"] + [(2, "same", y) for y in "zy"] + [(None, "a", "n"), (None, "a", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    shown = [sorted((r["doc_id"] or 0, r["text"], r["extra"]) for r in P.near_duplicates(spark, docs.repartition(n), sf).collect()) for n in (1, 5)]
    assert shown[0] == shown[1] and [r[0] for r in shown[0]] == [0, 0, 1, 2] and shown[0][3][2] == "y"


def test_passages_are_cut_as_plainly(spark, sf, documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    counts = brute.words_removed([(d, r["text"]) for d, r in rows.items()])
    got = {r["doc_id"]: r for r in P.repeated_passages(spark, documents, sf).collect()}
    assert set(got) == {d for d, (n, gone, _) in counts.items() if gone < n or not gone}
    for d, r in got.items():
        import hashlib
        n, gone, digest = counts[d]
        assert r["n_chars"] == (len(r["text"]) if gone else rows[d]["n_chars"])
        assert hashlib.sha256(" ".join(brute.WORD.findall(r["text"] or "")).encode()).hexdigest() == digest


def test_run_applies_the_stages_in_order(spark, sf):
    import public_tokenizers as known
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.staged(stage(spark, docs, sf), "pipeline-test")
    encoder = Tokenizer.from_file(known.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(encoder.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in P.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in got.items()} == want
    for p in got.values():
        ends = 0
        for start, n in sorted(p):
            assert start == ends
            ends += n
