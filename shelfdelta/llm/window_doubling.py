"""Substring dedup on words by level-wise doubling.

Level one takes windows of half the wanted length, one per anchor (see ``anchors``), and keeps
those that another text has. Only they are extended to the full length, and a window of that
length survives if another document has it. ``repeated_passages`` goes on: a window of twice the
length is a candidate if both its halves survived, until no candidate is left.

Windows are compared by 96-bit hashes of their words' bytes. Whole copies of a text are
settled by its digest and take no part in the levels.

Defined results: a null text has no words; texts shorter than a window keep everything; a row
with a null id keeps everything and removes nothing from others; rows that repeat an id count as
one document, so they remove nothing from each other; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfdelta.llm.anchors import text_classes, window_minima
from shelfdelta.llm.common import WordHash, gram_hashes, map_rows, signed, staged, text_or_empty, word_hashes, word_spans

_WORDS, _CHECK = WordHash(101), WordHash(202)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _anchor_minima(hashes: np.ndarray, words: int, first: int) -> np.ndarray:
    if len(hashes) < words:
        return np.empty(0, dtype=np.uint64)
    return window_minima(gram_hashes(hashes, first), words - first + 1)


def _first_keys(hashes: np.ndarray, words: int, at: np.ndarray | None = None) -> np.ndarray:
    """The first hash of each window of ``words`` words, or of those that start ``at``."""
    if len(hashes) < words:
        return np.empty(0, dtype=np.int64)
    return signed(gram_hashes(hashes, words, 0xD6E8FEB86659FD93, at))


def _second_keys(data: np.ndarray, words: int, at: np.ndarray) -> np.ndarray:
    """An independent hash of the windows that start ``at``; it looks at the bytes of their words alone."""
    starts, ends = word_spans(data)
    used = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + words, -1)
    inside = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    hashes[inside] = _CHECK.spans(data, starts[inside], ends[inside])
    return (gram_hashes(hashes, words, at=at) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def candidates(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, alive) of the first texts of their class: anchors of half length that others have."""
    first = (words + 1) // 2

    def rows(batch: pa.RecordBatch) -> list:
        where, anchor, again = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            values = np.unique(_anchor_minima(word_hashes(_bytes(text), _WORDS), words, first))
            anchor.append(signed(values))
            where.append(np.full(len(values), i))
        where = pa.array(np.concatenate(where) if where else [], pa.int64())
        return [batch.column(0).take(where), batch.column(1).take(where), np.concatenate(anchor) if anchor else []]

    found = map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), rows, "doc_id long, text_key long, anchor long")
    # Anchors are made and shuffled once; a window over equal anchors spills and holds no group in memory.
    equal = Window.partitionBy("anchor")
    seen = found.withColumn("least", F.min("text_key").over(equal)).withColumn("most", F.max("text_key").over(equal))
    return seen.where("least < most").groupBy("doc_id").agg(F.collect_list("anchor").alias("alive"))


def windows(docs: DataFrame, alive: DataFrame, words: int, once: bool = False) -> DataFrame:
    """(doc_id, at, one, two) of the windows of ``words`` words over a living anchor; equal ones of a document only ``once``."""
    half = (words + 1) // 2

    def rows(batch: pa.RecordBatch) -> list:
        where, at, one, two = [], [], [], []
        living = batch.column(2)
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = _bytes(text)
            hashes = word_hashes(data, _WORDS)
            keep = np.flatnonzero(np.isin(signed(_anchor_minima(hashes, words, half)), living[i].values.to_numpy()))
            if len(keep):
                a = _first_keys(hashes, words, keep)
                if once:
                    a, firsts = np.unique(a, return_index=True)
                    keep = keep[firsts]
                where.append(np.full(len(keep), i))
                at.append(keep)
                one.append(a)
                two.append(_second_keys(np.frombuffer(data, dtype=np.uint8), words, keep))
        if not where:
            return [[], [], [], []]
        return [batch.column(0).take(pa.array(np.concatenate(where))), np.concatenate(at), np.concatenate(one), np.concatenate(two)]

    return map_rows(docs.join(alive, "doc_id").select("doc_id", "text", "alive"), rows, "doc_id long, at int, one long, two int")


def later_windows(found: DataFrame) -> DataFrame:
    """(doc_id, at) of windows that a smaller doc_id has. Rows are made and shuffled once; equal windows spill."""
    first = F.min("doc_id").over(Window.partitionBy("one", "two"))
    return found.withColumn("first_id", first).where("doc_id > first_id").select("doc_id", "at")


def shared_windows(found: DataFrame) -> DataFrame:
    """(doc_id, at) of windows that two documents have."""
    equal = Window.partitionBy("one", "two")
    seen = found.withColumn("first_id", F.min("doc_id").over(equal)).withColumn("last_id", F.max("doc_id").over(equal))
    return seen.where("first_id < last_id").select("doc_id", "at")


def repeated_passages(docs: DataFrame, words: int = 13) -> DataFrame:
    """(doc_id, at, length): windows that two documents have, at each doubled length until none is left."""
    docs = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    level = staged(shared_windows(windows(docs, candidates(docs, words), words)), "level")
    out, length = level.withColumn("length", F.lit(words)), words
    while not level.isEmpty():
        length *= 2
        # Both halves survived: the window at ``at`` and the one half a length on.
        both = level.join(level.select("doc_id", (F.col("at") - length // 2).alias("at")), ["doc_id", "at"])
        starts = both.groupBy("doc_id").agg(F.collect_list("at").alias("starts"))

        def rows(batch: pa.RecordBatch, n: int = length) -> list:
            where, at, one, two = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data, keep = _bytes(text), np.sort(batch.column(2)[i].values.to_numpy())
                where.append(np.full(len(keep), i))
                at.append(keep)
                one.append(_first_keys(word_hashes(data, _WORDS), n, keep))
                two.append(_second_keys(np.frombuffer(data, dtype=np.uint8), n, keep))
            if not where:
                return [[], [], [], []]
            return [batch.column(0).take(pa.array(np.concatenate(where))), np.concatenate(at), np.concatenate(one), np.concatenate(two)]

        found = map_rows(docs.join(starts, "doc_id").select("doc_id", "text", "starts"), rows, "doc_id long, at int, one long, two int")
        level = staged(shared_windows(found), "level")
        out = out.unionByName(level.withColumn("length", F.lit(length)))
    return out


def deduplicated(docs: DataFrame, *, words: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text and source_sha256 (the text's; both null where nothing was
    removed), kept_sha256.

    A word goes if a window of ``words`` words over it also starts in a document with a smaller
    id, judged on the input.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    known = docs.where("doc_id is not null")
    classes = staged(text_classes(docs), "text-classes")
    firsts = classes.where("doc_id = first_id").select("doc_id")
    alive = staged(candidates(known, words).join(firsts, "doc_id"), "alive")
    later = later_windows(windows(known, alive, words, once=True)).groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    # A later copy goes as a whole if it is as long as a window: marked by the start -1.
    copies = classes.where("doc_id <> first_id").select("doc_id", F.array(F.lit(-1)).alias("starts"))
    gone = later.unionByName(copies)
    cut = known.join(gone, "doc_id", "left").unionByName(docs.where("doc_id is null").withColumn("starts", F.lit(None).cast("array<int>")))

    def rows(batch: pa.RecordBatch) -> list:
        total, removed, kept, source, digest = [], [], [], [], []
        for i, body in enumerate(batch.column(1).to_pylist()):
            data = _bytes(body)
            starts, ends = word_spans(np.frombuffer(data, dtype=np.uint8))
            n = len(starts)
            hit = batch.column(2)[i]
            covered = np.zeros(n, dtype=bool)
            if hit.is_valid and n >= words:
                at = hit.values.to_numpy()
                if at[0] < 0:
                    covered[:] = True
                else:
                    keys = _first_keys(_WORDS.spans(np.frombuffer(data, dtype=np.uint8), starts, ends), words)
                    at = np.flatnonzero(np.isin(keys, keys[at[at + words <= n]]))  # all places of each such window
                    change = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + words, -1)
                    covered = np.cumsum(change[:-1]) > 0
            stay = np.flatnonzero(~covered)
            out = b" ".join([data[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())])
            total.append(n)
            removed.append(n - len(stay))
            kept.append(out.decode("utf-8", "surrogatepass") if len(stay) < n else None)
            source.append(hashlib.sha256(data).hexdigest() if len(stay) < n else None)
            digest.append(hashlib.sha256(out).hexdigest())
        return [batch.column(0), total, removed, kept, source, digest]

    return map_rows(cut.select("doc_id", "text", "starts"), rows, "doc_id long, n_words long, n_removed long, kept_text string, source_sha256 string, kept_sha256 string")
