"""Similarity join on word n-grams: MinHash bands find candidates, full sets decide.

1. Equal texts are one class; its first document stands for it.
2. Each class gets a MinHash signature cut into bands. ``bands_for`` picks the number of bands and
   rows so that a pair at the threshold shares a band with ``recall``. Bands are shuffled by
   their hash; classes that share one are joined into candidate groups.
3. Candidate groups are verified in blocks: the full n-gram hash sets of a block of at most
   ``BLOCK`` texts, or of two such blocks of one large group, meet in one task, which counts common n-grams of
   all pairs as a matrix product. No pair leaves the task: it returns how many links each
   text has there and a spanning forest of the links.
4. Components of the forests are the classes of the result.

A link is a resemblance of at least ``threshold`` (0.8) of the sets of five-word n-grams; a text
of fewer words has one n-gram of all its words.

Defined results: null texts, and texts without words, have no n-grams, no links and a class of
their own; equal texts with words are links; rows that repeat an id are one document (the
one whose text has the least digest); null ids are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfdelta.llm.common import WordHash, gram_hashes, list_array, map_rows, mix, signed, staged, text_or_empty, word_hashes

THRESHOLD, GRAM, RECALL, BLOCK, COLUMNS = 0.8, 5, 0.995, 512, 4096
_WORDS = WordHash(51)


def bands_for(threshold: float, recall: float, most: int = 16) -> tuple[int, int]:
    """(bands, rows) with the most rows that reach ``recall`` at the threshold within ``most`` bands."""
    for rows in range(12, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def gram_set(text: str, n: int = GRAM) -> np.ndarray:
    return np.unique(gram_hashes(word_hashes(text.encode("utf-8", "surrogatepass"), _WORDS), n))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the MinHash signature."""
    k = bands * rows
    rng = np.random.default_rng(77)
    odd, add = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)
    least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at:at + 2048]
        for j in range(k):
            # multiply-add modulo 2**64, high bits first: a fresh order for each j
            least[j] = min(least[j], (part * odd[j] + add[j]).min())
    out = np.zeros(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(31) + least.reshape(bands, rows)[:, r] + np.uint64(r))
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, least): the least node of each node's component, for ``edges`` (a, b).

    Alternates: every node takes the least label among its neighbours, then the label of its
    label. Rounds grow with the logarithm of a chain's length; each is a written table.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("least")), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "least"), "b").groupBy("a").agg(F.min("least").alias("near"))
        # A node's label passes its news on to the node it points at, too (hooking).
        hook = labels.select(F.col("least").alias("a"), "node").join(seen.select(F.col("a").alias("node"), "near"), "node").groupBy("a").agg(F.min("near").alias("hooked"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").join(hook.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.least("least", "near", "hooked").alias("low"), F.col("least").alias("old"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = staged(step.join(jump, "low", "left").select("node", F.least("low", "lower").alias("least"), "old"), f"{name}-labels")
        labels = new.select("node", "least")
        if new.where("least <> old").isEmpty():
            return labels


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the linked pairs (rows of ``links``), by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in links.tolist():
        x, y = int(a[i]), int(b[j])
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of common n-grams of all pairs of ``sets``."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[column] > 1  # an n-gram of one text is common to no pair
    number = np.cumsum(count > 1) - 1
    owner, column = owner[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for base in range(0, int(count[count > 1].size), COLUMNS):
        lo, hi = np.searchsorted(column, [base, base + COLUMNS])
        rows = np.unique(owner[lo:hi])
        part = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        part[np.searchsorted(rows, owner[lo:hi]), column[lo:hi] - base] = 1
        out[np.ix_(rows, rows)] += part @ part.T
    return out


def verified(units: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, links, other): link counts (other null), and spanning edges (links null).

    ``units`` has unit, team (a group within the unit), doc_id, copies, side and grams. Pairs on
    different sides are compared where a team has two sides, else all pairs.
    """
    def run(table: pa.Table) -> pa.Table:
        team = table.column("team").to_numpy()
        side, doc, copies = (table.column(c).to_numpy() for c in ("side", "doc_id", "copies"))
        grams = table.column("grams").combine_chunks()
        ids, links, other = [], [], []
        order = np.lexsort((doc, side, team))
        for rows in np.split(order, np.flatnonzero(np.diff(team[order])) + 1):
            if not len(rows):
                continue
            sets = [grams[int(i)].values.to_numpy() for i in rows]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = common_grams(sets)
            near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            if side[rows[-1]] > 0:
                near &= side[rows][:, None] != side[rows][None, :]
            np.fill_diagonal(near, False)
            count = near @ copies[rows]
            ids += doc[rows].tolist()
            links += count.tolist()
            other += [None] * len(rows)
            for a, b in _forest(np.argwhere(np.triu(near)), doc[rows], doc[rows]):
                ids.append(a)
                links.append(None)
                other.append(b)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})

    return units.groupBy("unit").applyInArrow(run, "doc_id long, links long, other long")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, n: int = GRAM, recall: float = RECALL, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), text_id (least id with its text), links."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # One text an id; of several the one with the least digest.
    heads = docs.groupBy("doc_id").agg(F.min(F.sha2("text", 256)).alias("digest"))
    per_text = heads.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    members = staged(heads.join(per_text, "digest").select("doc_id", "text_id", "copies", "digest"), "text-members")
    stands = members.where("doc_id = text_id").select("doc_id", "copies", "digest")

    def banded(batch: pa.RecordBatch) -> list:
        who, out, empty = [], [], np.empty(0, dtype=np.uint64)
        for body in batch.column(1).to_pylist():
            grams = gram_set(body, n)
            out.append(signed(band_hashes(grams, bands, rows) if len(grams) else empty))
            who.append(len(grams) > 0)
        return [batch.column(0), batch.column(2), who, list_array(out, pa.int64())]

    signed_docs = map_rows(docs.select("doc_id", "text", F.sha2("text", 256).alias("digest")), banded,
                           "doc_id long, digest string, worded boolean, bands array<long>")
    signatures = staged(signed_docs.join(stands, ["doc_id", "digest"]).dropDuplicates(["doc_id"]).where("worded").select("doc_id", "copies", "bands"), "signatures")
    banded_rows = signatures.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    buckets = banded_rows.groupBy("band", "hash").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last")
    edges = banded_rows.join(buckets, ["band", "hash"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    groups = staged(components(edges, "candidates").join(signatures.select(F.col("doc_id").alias("node"), "copies"), "node").select(
        F.col("node").alias("doc_id"), F.col("least").alias("team"), "copies"), "groups")

    # Large groups are dealt to blocks by a hash of the id; every two blocks meet in a unit.
    size = groups.groupBy("team").agg(F.count(F.lit(1)).alias("n")).select("team", F.greatest(F.lit(1), F.ceil(F.col("n") * 1.2 / BLOCK)).cast("int").alias("blocks"))
    dealt = groups.join(size, "team").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    units = max(1, groups.count() // BLOCK)
    whole = dealt.where("blocks = 1").select("doc_id", "copies", "team", F.array(F.struct(
        F.pmod(F.xxhash64("team"), F.lit(units)).cast("string").alias("unit"), F.lit(0).alias("side"))).alias("places"))
    i, k = F.col("block"), F.col("blocks")
    pair = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(
        F.concat_ws("/", F.lit("block"), F.col("team"), F.least(i, j), F.greatest(i, j)).alias("unit"), (i > j).cast("int").alias("side")))
    split = dealt.where("blocks > 1").select("doc_id", "copies", "team", pair.alias("places"))
    placed = whole.unionByName(split)

    def with_grams(batch: pa.RecordBatch) -> list:
        return [*batch.columns[1:], list_array([signed(gram_set(t, n)) for t in batch.column(0).to_pylist()], pa.int64())]

    texts = docs.select("doc_id", "text").join(placed.join(stands.select("doc_id", "digest"), "doc_id"), "doc_id").where(
        F.sha2("text", 256) == F.col("digest")).select("text", "doc_id", "copies", "team", "places")
    ready = map_rows(texts, with_grams, "doc_id long, copies long, team long, places array<struct<unit:string,side:int>>, grams array<long>")
    ready = ready.dropDuplicates(["doc_id"]) if _repeats(members, docs) else ready
    found = staged(verified(ready.select("doc_id", "copies", "team", "grams", F.inline("places")), threshold), "links")
    classes = components(found.where("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")), "classes")
    counts = found.where("other is null").groupBy("doc_id").agg(F.sum("links").alias("links"))
    return members.join(classes.select(F.col("node").alias("text_id"), "least"), "text_id", "left").join(
        counts.withColumnRenamed("doc_id", "text_id"), "text_id", "left").join(
        signatures.select(F.col("doc_id").alias("text_id"), F.lit(True).alias("worded")), "text_id", "left").select(
        "doc_id", F.when(F.col("worded"), F.coalesce("least", "text_id")).otherwise(F.col("doc_id")).alias("class_id"), "text_id",
        F.when(F.col("worded"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("links"))


def _repeats(members: DataFrame, docs: DataFrame) -> bool:
    """Whether some id stands on several rows; then rows of one id are collapsed before they are compared."""
    return members.count() < docs.count()
