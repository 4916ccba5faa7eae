"""Lossless pruning for exact repeat search: which parts of a text can be repeated at all.

Every window of a text elects its least short-gram hash, its anchor. Equal windows elect equal
anchors, so a window whose anchor no other text has is not repeated elsewhere. Only anchors
travel in the first shuffle: about two in ``width + 1`` grams are elected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive hashes, by doubling."""
    out, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def runs(minima: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of windows that elect the same value, cut at ``longest``."""
    if not len(minima):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    edge = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
    size = np.diff(np.append(edge, len(minima)))
    if size.max(initial=0) > longest:
        parts = -(-size // longest)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        edge = np.repeat(edge, parts) + inner * longest
        size = np.diff(np.append(edge, len(minima)))
    return edge, size


def elected(hashes: np.ndarray, minima: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a text, and which of them are elected at several positions."""
    if not len(minima):
        return minima, np.empty(0, dtype=bool)
    # A gram is elected if some window that holds it has no lesser one: its value is the greatest of its windows' minima.
    edge = np.zeros(width - 1, dtype=np.uint64)
    reach = ~window_minima(~np.concatenate([edge, minima, edge]), width)
    values, count = np.unique(hashes[reach == hashes], return_counts=True)
    return values, count > 1


def shared(anchors: DataFrame, entry: Column | str = "anchor") -> DataFrame:
    """Per doc_id, the array ``alive`` of its anchors (of ``entry`` for each) that a different text has too.

    ``anchors`` has doc_id, text_key (equal for equal texts), anchor, and ``again`` where the anchor
    is elected at several positions of the text itself, which makes it alive alone. Counting combines on the map
    side; the way back is a join on the anchor, whose hot keys AQE splits.
    """
    # A second key of its own stands for the text's second position.
    other = F.when(F.col("again"), F.col("text_key").bitwiseXOR(F.lit(1))).otherwise(F.col("text_key"))
    alive = anchors.groupBy("anchor").agg(F.min(F.least("text_key", other)).alias("least"), F.max(F.greatest("text_key", other)).alias("most")).where(
        "least < most").select("anchor")
    return anchors.select("doc_id", "anchor", "again").join(alive, "anchor").groupBy("doc_id").agg(F.collect_list(entry).alias("alive"))


MOST_BITS = 1 << 24


def probable(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not in ``wanted``; none of the others is lost.

    A bitmap with 16 bits per wanted id, at most ``MOST_BITS`` (262,144 words of 64 bits, the proven size of
    the broadcast), is looked up before the texts are shuffled. Beyond that it lets more rows through.
    """
    wish = 16 * wanted.count()
    bits = 1 << min(max(wish, 64).bit_length(), MOST_BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = wanted.select((place / 64).cast("long").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("_bits")).groupBy(
        "_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = docs.withColumn("_place", place).withColumn("_word", (F.col("_place") / 64).cast("long"))
    hit = F.getbit(F.col("_bits"), F.pmod(F.col("_place"), F.lit(64)).cast("int")) == 1
    return marked.join(F.broadcast(words), "_word").where(hit).select(*docs.columns)


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id): the least id that has the same whole text. Null ids are left out."""
    heads = docs.where("doc_id is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = heads.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return heads.join(firsts, "digest").select("doc_id", "first_id").distinct()
