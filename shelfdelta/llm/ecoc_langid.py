"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit one binary classifier over hashed byte 3-grams
tells languages whose codeword has the bit from the others. A text's bit margins are decoded
to the codeword of least exponential loss, each bit weighted by how well its classifier does
on that language.

How far a text's evidence agrees with a codeword is measured against what training texts of that
language show on average: 1 is typical, 0 is no evidence. The score is the mean of that and of its
lead over the second language, held to 0 to 1. Texts with too small a lead (mixed languages) or too little
agreement (unseen scripts, gibberish) are flagged ambiguous.

``train`` counts grams of a bounded sample of labelled rows (about ``per_language`` of each
language, by document hash) in Spark; the driver sees one count per language and gram bucket.
``predict`` reads whole texts and nothing but texts.

Defined results: null texts and texts without a letter are ``und`` with score 0 and count as
ambiguous; with no labelled rows everything is ``und``; with one language every text with a
letter gets it, score 1. Equal texts get equal results; other columns pass through.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.llm.common import map_rows

BUCKET_BITS = 15
_BUCKETS = 1 << BUCKET_BITS
_FIXED = 1_000_000  # whole numbers add up alike in any order
# Bytes that are no part of a letter become blanks, so junk between words carries nothing.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray       # languages x bits, -1 or 1
    weights: np.ndarray     # buckets x bits
    trust: np.ndarray       # languages x bits, rows sum to 1
    typical: np.ndarray     # mean agreement of a language's own training texts


def codewords(n: int) -> np.ndarray:
    """Exhaustive code up to seven languages, then distinct random codewords far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        near = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        if near > far:
            best, far = code, near
    return best


def grams(text: str) -> np.ndarray:
    """Buckets of the text's byte 3-grams, words set off by single blanks."""
    plain = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" "
    data = np.frombuffer(plain, dtype=np.uint8).astype(np.uint32)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def evidence(model: Model, text: str) -> np.ndarray:
    """The mean weight of the text's grams, one value per bit."""
    at = grams(text)
    if len(at) > 200_000:
        return np.bincount(at, minlength=_BUCKETS) @ model.weights / len(at)
    return model.weights[at].mean(axis=0)


def decode(model: Model, mean: np.ndarray) -> tuple[int, float, float, float]:
    """The nearest codeword, the score, the agreement with it and its lead over the next."""
    loss = (model.trust * np.exp(-model.codes * np.tanh(8 * mean))).sum(axis=1)
    best = int(np.argmin(loss))
    if len(loss) == 1:
        return best, 1.0, 1.0, 1.0
    agreement = agreements(model, mean) / model.typical
    lead = float(agreement[best] - np.delete(agreement, best).max())
    return best, float(np.clip((agreement[best] + lead) / 2, 0, 1)), float(agreement[best]), lead


def agreements(model: Model, mean: np.ndarray) -> np.ndarray:
    """Per language how far the evidence goes its codeword's way."""
    return model.codes @ mean / model.codes.shape[1]


def train(docs: DataFrame, usable: Column | None = None, *, per_language: int = 2000, text: str = "text",
          label: str = "lang", key: str = "doc_id") -> Model:
    """Fit on about ``per_language`` rows of each language among the ``usable`` rows."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if usable is None else usable))
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((_BUCKETS, 1)), np.ones((0, 1)), np.ones(0))
    number = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / sizes[name]))])
    roll = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(roll < F.element_at(share, F.col(label))).select(F.col(text).alias("text"), F.col(label).alias("label"))

    def counted(batch: pa.RecordBatch) -> list:
        table = np.zeros((len(languages), _BUCKETS), dtype=np.int64)
        for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(body):
                # A document counts with its square root, so that no long text rules a language.
                at = grams(body)
                table[number[name]] += np.bincount(at, weights=np.full(len(at), 1000 / np.sqrt(len(at))), minlength=_BUCKETS).astype(np.int64)
        which, bucket = np.nonzero(table)
        return [which, bucket, table[which, bucket]]

    counts = np.zeros((len(languages), _BUCKETS))
    for r in map_rows(sample, counted, "which long, bucket long, n long").groupBy("which", "bucket").agg(F.sum("n")).collect():
        counts[r[0], r[1]] = r[2]
    codes = codewords(len(languages))
    freq = (counts + 1.0) / (counts.sum(axis=1, keepdims=True) + _BUCKETS)
    weights = np.zeros((_BUCKETS, codes.shape[1]))
    for b in range(codes.shape[1]):
        ones, zeros = freq[codes[:, b] > 0], freq[codes[:, b] < 0]
        if len(zeros):
            weights[:, b] = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
    model = Model(languages, codes, weights, np.full(codes.shape, 1 / codes.shape[1]), np.ones(len(languages)))

    def right(batch: pa.RecordBatch) -> list:
        hits, seen, agreed = np.zeros(codes.shape, dtype=np.int64), np.zeros(len(languages), dtype=np.int64), np.zeros(len(languages), dtype=np.int64)
        for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if has_letter(body):
                i, mean = number[name], evidence(model, body)
                hits[i] += mean * codes[i] > 0
                seen[i] += 1
                agreed[i] += round(float(agreements(model, mean)[i]) * _FIXED)
        which, bit = np.indices(codes.shape).reshape(2, -1)
        return [which, bit, hits.ravel(), seen[which], agreed[which]]

    told = map_rows(sample, right, "which long, bit long, hits long, seen long, agreed long").groupBy("which", "bit")
    for r in told.agg(F.sum("hits"), F.sum("seen"), F.sum("agreed")).collect():
        model.trust[r[0], r[1]] = (r[2] + 1) / (r[3] + 2)
        model.typical[r[0]] = max(r[4] / _FIXED / max(r[3], 1), 1e-6)
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, *, text: str = "text", least_lead: float = 0.35, least_agreement: float = 0.3) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ambiguous."""
    handed = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x bits
    taken = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in taken)
    at = taken.index(text)

    def rows(batch: pa.RecordBatch) -> list:
        m, out = handed.value, ([], [], [])
        for body in batch.column(at).to_pylist():
            if m.languages and has_letter(body):
                best, score, agreement, lead = decode(m, evidence(m, body))
                found = (m.languages[best], round(score, 6), lead < least_lead or agreement < least_agreement)
            else:
                found = ("und", 0.0, True)
            for column, value in zip(out, found, strict=True):
                column.append(value)
        return [*batch.columns, *out]

    return map_rows(docs.select(*[F.col(f"`{c}`") for c in taken]), rows, f"{fields}, lang_pred string, lang_score double, lang_ambiguous boolean")
