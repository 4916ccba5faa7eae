"""Document fingerprints: one-permutation MinHash with optimal densification, few bits kept.

The hash of each five-word shingle is computed once; its high bits choose a bin, the rest is
the value, and every bin keeps its least value. An empty bin takes the value of a bin chosen
by hashing (bin, attempt) until that one is not empty, the same for all documents. The low
``KEPT_BITS`` bits of each bin are packed as hexadecimal text. Two fingerprints agree by
chance in a bin with probability 2**-KEPT_BITS; ``likeness`` corrects for that.

Defined results: a null text is empty; a text without words has the empty fingerprint, like
itself (1) and unlike all others (0); fewer than five words are one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfdelta.llm.common import RollingHash, arrow_schema, gram_hashes, map_rows, mix, slices, staged, text_or_empty, word_hashes

BINS, KEPT_BITS, SHINGLE = 256, 4, 5
_WORDS = RollingHash(31)
_BIN_SHIFT = np.uint64(64 - int(np.log2(BINS)))


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins from bins picked by a hash of (bin, attempt)."""
    out, empty, attempt = values.copy(), np.flatnonzero(~filled), 1
    while len(empty):
        pick = (mix(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)
        ready = filled[pick]
        out[empty[ready]] = values[pick[ready]]
        empty, attempt = empty[~ready], attempt + 1
    return out


def fingerprint(text: str) -> str:
    words = word_hashes(text.encode("utf-8", "surrogatepass"), _WORDS)
    if len(words) == 0:
        return ""
    hashes = np.sort(gram_hashes(words, SHINGLE))
    bins = (hashes >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, filled = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    values[bins[first]], filled[bins[first]] = hashes[first], True
    low = (densify(values, filled) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)
    return ((low[::2] << 4) | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated resemblance of the shingle sets, 0 to 1."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    differ = x ^ y
    match = 1 - (np.count_nonzero(differ & 15) + np.count_nonzero(differ >> 4)) / BINS
    chance = 2.0**-KEPT_BITS
    return max(0.0, (match - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def compared(text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, other,
            likeness(mark, other), likeness(mark, next_mark))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fingerprint of each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text_or_empty(text).alias("text")),
                    lambda b: [b.column(0), [fingerprint(t) for t in b.column(1).to_pylist()]], f"`{key}` {kind}, fingerprint string")


_ROW = "part int, place int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def with_neighbours(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited self and the next one, by descending key.

    One range exchange sorts the texts; neighbours meet inside a partition as it streams by.
    Only the first and last row of each partition keep their text, for the second step that
    joins the ends of consecutive partitions. Rows with equal keys are ordered by text; a null key comes last.
    """

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # text's hash makes the order of equal keys a matter of content, not of arrival
    ordered = ordered.withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("_tie")).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), F.col("_tie"))
    schema = arrow_schema(_ROW)
    names = schema.names

    def run(batches):
        from pyspark import TaskContext

        part, before, began = TaskContext.get().partitionId(), None, False
        for batch in batches:
            for piece in slices(batch):
                out = []
                for doc, body in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    mark = fingerprint(body)
                    if not began:
                        out.append((part, 0, doc, None, None, mark, None, None, None, body))
                        began = True
                    if before is not None:
                        out.append((part, 1, before[0], *compared(before[1], before[2], body, mark), None))
                    before = (doc, body, mark)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], names=names)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (part, 2, before[0], len(before[1]), None, before[2], None, None, None, before[1]), schema.types, strict=True)], names=names)

    made = staged(ordered.mapInArrow(run, _ROW), "fingerprints")
    # Two rows a partition: numbered by the driver from the list of partitions that had rows.
    parts = [r[0] for r in made.where("place = 0").select("part").orderBy("part").collect()]
    inner = made.where("place = 1").select(*names[2:-1])
    if not parts:
        return inner
    follows = F.create_map(*[F.lit(x) for a, b in zip(parts, parts[1:] + parts[:1], strict=True) for x in (a, b)])
    heads = made.where("place = 0").select(F.col("part").alias("head_part"), F.col("text").alias("head_text"), F.col("fingerprint").alias("head_mark"))
    tails = made.where("place = 2").select("doc_id", "text", "fingerprint", follows[F.col("part")].alias("head_part")).join(heads, "head_part")

    def finish(batch: pa.RecordBatch) -> list:
        rows = [compared(t, m, n, k) for t, m, n, k in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True)]
        return [batch.column(0), *([list(c) for c in zip(*rows, strict=True)] or [[]] * 6)]

    ends = map_rows(tails.select("doc_id", "text", "fingerprint", "head_text", "head_mark"), finish,
                    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return inner.unionByName(ends)
