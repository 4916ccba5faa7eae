"""The classifier against plain arithmetic, its held-out accuracy, and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfdelta.llm import quality_classifier as qc
from shelfdelta.llm.queries import op11_quality_classifier


def test_updates_follow_the_leader():
    """Vector updates equal per-coordinate FTRL-proximal written out."""
    rates, rng, state = qc.Rates(0.3, 0.1, 0.01, 0.2), np.random.default_rng(1), qc.State(np.zeros(30), np.zeros(30))
    z, n = [0.0] * 30, [0.0] * 30

    def weight(i):
        if abs(z[i]) <= rates.l1:
            return 0.0
        return -(z[i] - math.copysign(rates.l1, z[i])) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(60):
        at = np.sort(rng.choice(30, 6, replace=False))
        value, label = rng.random(6), int(rng.random() < 0.6)
        state.learn(at, value, label, rates)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, value))))
        for i, v, w in [(i, v, weight(i)) for i, v in zip(at, value)]:
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates.alpha * w
            n[i] += g * g
    np.testing.assert_allclose(state.weights(rates), [weight(i) for i in range(30)], rtol=1e-9, atol=1e-12)


TEXTS = ["", " \n", "one", "The THE the### the### 12 a1,", "é ß Ünder x" * 3, "rep rep rep rep", "a " * 3000, "\x00 " + "x" * 5000]


def test_batches_score_as_texts_alone():
    weights = np.random.default_rng(2).normal(size=qc.BUCKETS + 1)
    data = [t.encode() for t in TEXTS]
    together = qc.scores(weights, data)
    made = list(qc.examples(data))
    for i, t in enumerate(data):
        which, bucket = qc.grams([t])
        words = t.decode().split(" ") and [w for w in t.decode().replace("\n", " ").split(" ") if w]
        assert len(bucket) == max(2 * len(words) + 2 * (len(words) - 1), 0)
        mean = sum(weights[b] for b in bucket) / max(len(bucket), 1)
        want = 1 / (1 + math.exp(-(weights[qc.BUCKETS] + 16 * mean)))
        assert together[i] == pytest.approx(want) == pytest.approx(qc.scores(weights, [t])[0])
        at, value = made[i]
        assert float(qc.logistic(weights[at] @ value)) == pytest.approx(want)


def test_pieces_keep_every_word(monkeypatch):
    monkeypatch.setattr(qc, "PIECE", 10)
    text = b"a bb ccc dddddddddddddddddddddddddd e  f gggggggggg h " * 5
    assert b"".join(qc.pieces(text)) == text
    assert [w for p in qc.pieces(text) for w in p.split()] == text.split()
    assert list(qc.pieces(b"")) == [b""]


def test_held_out_rows_are_told_apart(spark, sf):
    got = op11_quality_classifier(spark, sf.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert len(rows) > 50 and sum(pairs) / len(pairs) > 0.98
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert sum(r["predicted"] for r in rows if r["quality"] == 1) >= 0.99 * len(good)


ODD = [(3, 1, "u"), (4, 0, None), (4, 1, "u"), (5, 0, "v"), (5, 0, "v"), (7, None, "v"), (9, 1, "v"), (8, 5, "v"), (None, 0, "v"), (77, 0, "v")]


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_odd_rows_score(spark, request, which):
    docs = request.getfixturevalue(which).withColumn("quality", F.lit("clash")).withColumn("quality_score", F.lit("old"))
    labels = spark.createDataFrame(ODD, "doc_id long, quality int, text string")
    weights = qc.train(docs, labels, rounds=2)
    rows = qc.predict(docs, weights).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["quality_score"] <= 1 and r["quality"] == "clash" for r in rows)
    if rows:
        alone = float(qc.logistic(weights[qc.BUCKETS]))
        assert all(r["quality_score"] == pytest.approx(alone, abs=1e-6) for r in rows if not (r["text"] or "").strip())
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r["text"] or "", r["quality_score"]) == r["quality_score"]


def test_only_usable_labels_are_learned(spark, odd_documents):
    labels = spark.createDataFrame(ODD, "doc_id long, quality int, text string")
    sample = qc.sampled(odd_documents, labels, F.col("doc_id") != 9, "quality", "text", "doc_id", 1000, 3).collect()
    assert sorted((r["key"], r["label"]) for r in sample) == [(3, 1), (5, 0)]
    assert not qc.train(odd_documents, labels.limit(0), rounds=1).any()
    assert {r["quality_score"] for r in qc.predict(odd_documents, qc.train(odd_documents, labels.limit(0), rounds=1)).collect()} == {0.5}
