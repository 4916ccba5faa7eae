"""What several operators share: text arrays, word spans and hashes, staging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.session import cut_lineage

# Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; lost executors cost a re-read."""
    return cut_lineage(df, f"llm-{name}")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes (modulo 2**64, over random byte values) of any spans of a byte string."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self._values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self._base = int(rng.integers(2**62, 2**63)) | 1
        self._inverse = pow(self._base, -1, 2**64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 1 << 17)
            powers = []
            for base in (self._base, self._inverse):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                powers.append(np.cumprod(steps, dtype=np.uint64))
            self._up, self._down = powers

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._values[data] * self._up[:len(data)], dtype=np.uint64, out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._down[starts])

    def windows(self, data: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hash of each k-byte window; ``prefix`` may come from another hash of the same seed."""
        self._grow(len(data) + 1)
        sums, n = self.prefix(data) if prefix is None else prefix, len(data) - k + 1
        return mix((sums[k:] - sums[:n]) * self._down[:n])


class WordHash:
    """Hashes of words: a sum of pseudo-random numbers, one for each byte value at each place.

    Unlike a polynomial modulo a power of two, no pattern of bytes makes two words collide by
    itself: any two different words do so with a chance of 2**-64.
    """

    def __init__(self, seed: int):
        self._seed = np.uint64(np.random.default_rng(seed).integers(2**62, 2**63)) | np.uint64(1)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if not len(size):
            return np.empty(0, dtype=np.uint64)
        # The bytes of all words in a row, each with its place in its word.
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.uint64) - np.repeat(begin.astype(np.uint64), size)
        at = place + np.repeat(starts.astype(np.uint64), size)
        number = mix(((place << np.uint64(8)) | data[at.view(np.int64)]) * np.uint64(0x9E3779B97F4A7C15) + self._seed)
        return mix(np.add.reduceat(number, begin) + size.astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of a UTF-8 byte array."""
    edge = np.ones(len(data) + 2, dtype=bool)
    edge[1:-1] = _SEPARATOR[data]
    flips = np.flatnonzero(edge[1:] != edge[:-1])
    return flips[::2], flips[1::2]


def word_hashes(text: bytes, hasher: RollingHash | WordHash) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_spans(data)
    return hasher.spans(data, starts, ends) if isinstance(hasher, WordHash) else hasher.spans(hasher.prefix(data), starts, ends)


def gram_hashes(words: np.ndarray, n: int, multiplier: int = 0x9E3779B97F4A7C15, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each window of ``n`` words, or of those that start ``at``; of all words together where there are fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    out = np.zeros(count if at is None else len(at), dtype=np.uint64)
    for j in range(n):
        out = (out + (words[j:j + count] if at is None else words[at + j])) * np.uint64(multiplier)
        out ^= out >> np.uint64(29)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, rows, schema: str, done=None) -> DataFrame:
    """``rows(dict of columns) -> list of column arrays`` over Arrow batches of ``df``.

    ``done`` is called at the end of a task: Python workers live on, and what they hold counts against the next job.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                # A batch of long texts is worked through in slices of some megabytes.
                for part in slices(batch):
                    made = rows(part)
                    yield pa.RecordBatch.from_arrays(
                        [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, out.types, strict=True)],
                        schema=out)
        finally:
            if done:
                done()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, target: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``target`` bytes."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * target / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per array of ``parts``."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), type=pa.list_(pa.field("element", kind)))
