"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

A text's features are its words, pairs of neighbouring words, and the same n-grams over word
shapes (case, digits, symbols, punctuation, length, repetition of the word before), all hashed
into ``BUCKETS`` buckets. A feature's value is its share of the text's n-grams, so a score is the
mean weight of the n-grams plus a bias: a sparse dot product.

``train`` takes about ``sample_rows`` labelled rows (by hash of the id; the bound of what it fits
on), deals them to ``shards`` and updates each shard's copy of the model row by row (FTRL-proximal:
per-bucket rates, L1 and L2). After each round the copies are averaged by bucket. The driver holds
one model of ``BUCKETS`` buckets, never rows. ``predict`` reads whole texts and nothing but texts.

Defined results: null texts, empty ones and those without words score as the bias alone says; with
no usable label every text scores 0.5; label rows that repeat an id count once and are left out
where they disagree, as are values other than 0 and 1 and null ids; rows of documents that repeat
an id give one example; equal texts score alike; an empty table gives an empty one. Other columns
pass through (a column named like the result is replaced). N-grams do not cross the cuts that
texts longer than ``PIECE`` bytes get at word ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.llm.common import RollingHash, list_array, map_rows, mix, staged, word_spans

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PIECE = 1 << 20
#: Values are shares times this, so that a feature of all n-grams weighs as much as the bias times it.
_SPREAD = 16.0
_HASH = RollingHash(303)
# Kinds of bytes: 0 lower case and beyond ASCII, 1 upper case, 2 digit, 3 punctuation, 4 other signs.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[128:] = 0
_KIND[ord("a"):ord("z") + 1], _KIND[ord("A"):ord("Z") + 1], _KIND[ord("0"):ord("9") + 1] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_BLANK = re.compile(rb"[ \t-\r]")
_FIXED = float(1 << 32)


@dataclass(frozen=True)
class Rates:
    alpha: float = 2.0
    beta: float = 0.05
    l1: float = 0.0005
    l2: float = 0.1


@dataclass
class State:
    """Per bucket the FTRL sums; the last entry is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> State:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))

    def weights(self, rates: Rates, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (rates.beta + np.sqrt(n)) / rates.alpha + rates.l2
        return np.where(np.abs(z) <= rates.l1, 0.0, (np.sign(z) * rates.l1 - z) / step)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, rates: Rates) -> None:
        """One example: distinct buckets, their values, 0 or 1."""
        w = self.weights(rates, at)
        slope = (logistic(float(w @ value)) - label) * value
        before = np.sqrt(self.n[at])
        self.n[at] += slope * slope
        self.z[at] += slope - (np.sqrt(self.n[at]) - before) / rates.alpha * w


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while (blank := _BLANK.search(text, at + PIECE)) is not None:
        yield text[at:blank.start()]
        at = blank.start()
    yield text[at:]


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A small number per word for how it is written."""
    kind = _KIND[data]
    counts = []
    for k in range(5):
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kind == k, out=sums[1:])
        counts.append(sums[ends] - sums[starts])
    lower, upper, digit, point, sign = counts
    case = np.select([(upper == 0) & (lower == 0), upper == 0, (upper == 1) & (kind[starts] == 1), lower == 0], [0, 1, 2, 3], 4)
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 5)
    again = np.zeros(len(words), dtype=np.int64)
    again[1:] = words[1:] == words[:-1]
    out = case
    for part, most in ((np.minimum(digit, 1), 2), (np.minimum(sign, 3), 4), (np.minimum(point, 3), 4), (length, 6), (again, 2)):
        out = out * most + part
    return out.astype(np.uint64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which text, bucket) of every n-gram, text after text."""
    cut = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    data = np.frombuffer(b"\n".join(p for _, p in cut) + b"\n", dtype=np.uint8)
    begins = np.cumsum([0] + [len(p) + 1 for _, p in cut[:-1]])
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    piece = np.searchsorted(begins, starts, side="right") - 1
    words = _HASH.spans(_HASH.prefix(data), starts, ends)
    shapes = mix(_shapes(data, starts, ends, words) + np.uint64(1))
    text_of = np.array([i for i, _ in cut])[piece]
    pair = np.flatnonzero(piece[1:] == piece[:-1])
    where, keys = [text_of, text_of, text_of[pair], text_of[pair]], [words, shapes + np.uint64(7)]
    for unit in (words, shapes):
        keys.append(mix(unit[pair] * np.uint64(0x9E3779B97F4A7C15) + unit[pair + 1]))
    bucket = (mix(np.concatenate(keys)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.concatenate(where), bucket


def examples(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets, bias last, and their values."""
    which, bucket = grams(texts)
    order = np.argsort(which, kind="stable")
    for mine in np.split(bucket[order], np.searchsorted(which[order], np.arange(1, len(texts)))):
        at, count = np.unique(mine, return_counts=True)
        yield np.append(at, BUCKETS), np.append(count * (_SPREAD / max(len(mine), 1)), 1.0)


def scores(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 per text, by dot products over all n-grams of the batch."""
    which, bucket = grams(texts)
    sums = np.bincount(which, weights=weights[bucket], minlength=len(texts))
    sizes = np.maximum(np.bincount(which, minlength=len(texts)), 1)
    return logistic(weights[BUCKETS] + sums * _SPREAD / sizes)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def sampled(docs: DataFrame, labels: DataFrame, usable: Column, label: str, text: str, key: str, sample_rows: int, shards: int) -> DataFrame:
    """(shard, place, label, at, value): the examples of about ``sample_rows`` usable labels."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & usable).groupBy(F.col(key).alias("key")).agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other").select("key", "label")
    roll = F.pmod(F.xxhash64("key", F.lit("quality sample")), F.lit(1 << 30))
    chance = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.where(roll < F.lit(int(chance * (1 << 30))))
    # About sample_rows rows of two numbers: the broadcast is bounded by the parameter.
    joined = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def rows(batch: pa.RecordBatch) -> list:
        made = list(examples(_bytes(batch.column(1))))
        return [batch.column(0), batch.column(2), list_array([a for a, _ in made], pa.int32()), list_array([v for _, v in made], pa.float64())]

    kind = joined.schema["key"].dataType.simpleString()
    made = map_rows(joined.select("key", F.coalesce("text", F.lit("")).alias("text"), "label"), rows, f"key {kind}, label int, at array<int>, value array<double>")
    # One example an id; among rows that repeat it the one with the least features.
    one = made.groupBy("key").agg(F.min(F.struct("label", "at", "value")).alias("x"))
    return one.select(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
                      F.xxhash64("key", F.lit("place")).alias("place"), "key", "x.label", "x.at", "x.value")


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, label: str = "quality", text: str = "text", key: str = "doc_id",
          sample_rows: int = 20_000, shards: int = 8, rounds: int = 4, rates: Rates = Rates()) -> np.ndarray:
    """Weights by bucket, bias last, learned from ``labels`` rows for which ``usable`` (over their columns) holds."""
    sample = staged(sampled(docs, labels, F.lit(True) if usable is None else usable, label, text, key, sample_rows, shards), "quality-sample")
    used = max(sample.select("shard").distinct().count(), 1)
    state = State.fresh()
    for _ in range(rounds):
        handed = docs.sparkSession.sparkContext.broadcast(state)  # bounded: two numbers a bucket

        def round_of(table: pa.Table) -> pa.Table:
            mine = State(handed.value.z.copy(), handed.value.n.copy())
            order = sorted(range(table.num_rows), key=lambda i: (table["place"][i].as_py(), table["key"][i].as_py()))
            for i in order:
                at, value = (table[c][i].values.to_numpy() for c in ("at", "value"))
                mine.learn(at, value, table["label"][i].as_py(), rates)
            moved = np.flatnonzero((mine.n != 0) | (mine.z != 0))
            # Whole numbers add up alike in any order.
            z, n = ((x[moved] * _FIXED).round().astype(np.int64) for x in (mine.z, mine.n))
            return pa.Table.from_arrays([pa.array(moved), pa.array(z), pa.array(n)], names=["bucket", "z", "n"])

        sums = sample.groupBy("shard").applyInArrow(round_of, "bucket long, z long, n long").groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        state = State.fresh()
        for r in sums.collect():  # at most one row a bucket
            state.z[r["bucket"]], state.n[r["bucket"]] = r["z"] / _FIXED / used, r["n"] / _FIXED / used
        handed.unpersist()
    return state.weights(rates)


def predict(docs: DataFrame, weights: np.ndarray, *, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score, 0 to 1, in column ``name``."""
    handed = docs.sparkSession.sparkContext.broadcast(weights)  # bounded: one number a bucket
    fields = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in fields].index(text)

    def rows(batch: pa.RecordBatch) -> list:
        return [*batch.columns, scores(handed.value, _bytes(batch.column(at))).round(6)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_rows(docs.select(*[F.col(f"`{f.name}`") for f in fields]), rows, f"{schema}, `{name}` double")
