"""Source divergence audit: how the terms of each source differ from its language's others.

Texts are read once. Each task counts its terms and writes one row per language and term: a
64-bit digest, the term and its counts by source. From there on only digests are shuffled. The
least and the greatest string of each digest show whether several terms share it; such a digest
is split by numbering its terms, so results are exact. Text is joined back for kept outputs alone.

A term is a run of ASCII letters and characters beyond ASCII, with A to Z lower-cased. A language
keeps the V terms that at least three of its documents (rows) have. A source, or the language as a
whole, gives a term p = 1 + floor(10**9 * (count + 1) / (N + V)), N its count over all kept terms;
f = floor((p - q)**2 / q). Pairs of sources are worked on in slices of the terms and tiles of the
sources, so that no task holds all of a language.

Defined results: null text, language and source are empty strings; a group without terms still has
its pairs; V = 0 gives pairs of value 0; a language with one source has no pairs; repeated rows
count as often as they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfdelta.llm.common import arrow_schema, slices, staged, text_or_empty

SCALE = 1_000_000_000
#: Terms a task holds before it writes them, terms of a slice (about), sources of a tile.
HELD, SLICE, TILE = 600_000, 16_384, 128
#: Split terms that may be broadcast; more are joined by a shuffle.
MOST_SPLIT = 100_000
_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_ONE = 1 << 40  # a document in a packed count: occurrences below, documents above
_AT = "array<struct<source:string,n:bigint,df:bigint>>"
_TERMS = f"lang string, digest long, term string, at {_AT}"
_PAIRS = "lang string, source string, item string, value long, seen long"


def terms_of(text: str, piece: int = 1 << 20) -> Counter:
    """Counts of the text's terms, read in pieces of some megabytes."""
    data, at, out = text.encode("utf-8", "surrogatepass").translate(_LETTERS), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def digests(terms: list[bytes], bits: int) -> np.ndarray:
    """The first ``bits`` bits of each term's BLAKE2b, as signed numbers."""
    joined = b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in terms])
    return np.frombuffer(joined, dtype=">i8").astype(np.int64) >> (64 - bits)


def counted(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, digest, term, at) of runs of rows, ``at`` the counts of each source: n occurrences in df rows."""
    out = arrow_schema(_TERMS)
    entry = out.field("at").type.value_type

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, sources in held.items():
            place: dict[bytes, int] = {}
            which = [np.fromiter((place.setdefault(t, len(place)) for t in group), dtype=np.int64, count=len(group)) for group in sources.values()]
            packed = np.concatenate([np.fromiter(group.values(), dtype=np.int64, count=len(group)) for group in sources.values()])
            owner = np.repeat(np.arange(len(sources)), [len(g) for g in sources.values()])
            term = np.concatenate(which)
            order = np.argsort(term, kind="stable")
            ends, names, terms = np.append(0, np.cumsum(np.bincount(term, minlength=len(place)))), pa.array(list(sources), pa.string()), list(place)
            for at in range(0, len(terms), 50_000):
                part = terms[at:at + 50_000]
                mine = order[ends[at]:ends[at + len(part)]]
                rows = pa.StructArray.from_arrays([names.take(pa.array(owner[mine])), pa.array(packed[mine] & (_ONE - 1)), pa.array(packed[mine] >> 40)],
                                                  fields=list(entry))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array(digests(part, bits)),
                    pa.array([t.decode("utf-8", "surrogatepass") for t in part], pa.string()),
                    pa.ListArray.from_arrays(pa.array((ends[at:at + len(part) + 1] - ends[at]).astype(np.int32)), rows, type=out.field("at").type)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = {}, 0, 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    group = held.setdefault(lang, {}).setdefault(source, {})
                    size, have = size - len(group), group.get
                    for term, n in terms_of(text).items():
                        group[term] = have(term, 0) + n + _ONE
                    size, rows = size + len(group), rows + 1
                    if size > HELD or rows == 1 << 20:  # so many rows fit the packed count
                        yield from flushed(held)
                        held, size, rows = {}, 0, 0
        yield from flushed(held)

    return docs.select("lang", "source", "text").mapInArrow(run, _TERMS)


def split(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms by (digest, sub) without their text, and the text of each (digest, sub)."""
    known = staged(terms.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "divergence-terms")
    single = known.where("low = high").select("digest", F.lit(0).alias("sub"), F.col("low").alias("term"))
    plain = terms.select("lang", "digest", F.lit(0).alias("sub"), "at")
    clashing = known.where("low < high").select("digest")
    if clashing.isEmpty():
        return plain, single
    several = terms.join(clashing, "digest").groupBy("digest", "term").agg(F.lit(1).alias("one"))
    numbered = staged(several.select("digest", "term", F.row_number().over(Window.partitionBy("digest").orderBy("term")).alias("sub")), "divergence-split")
    handed = F.broadcast(numbered) if numbered.count() <= MOST_SPLIT else numbered
    keyed = terms.join(handed, ["digest", "term"], "left").select("lang", "digest", F.coalesce("sub", F.lit(0)).alias("sub"), "at")
    return keyed, single.unionByName(numbered)


def kept_terms(terms: DataFrame, least_documents: int) -> DataFrame:
    """(lang, digest, sub, n_lang, at): the terms of enough documents with each source's count.

    One shuffle by term; a term has one row per run of rows that has it, and these are added up as they come.
    """
    met = terms.repartition("lang", "digest", "sub").select("lang", "digest", "sub", F.inline("at"))
    by_source = met.groupBy("lang", "digest", "sub", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return by_source.groupBy("lang", "digest", "sub").agg(
        F.sum("n").alias("n_lang"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("at")).where(
        F.col("df") >= least_documents).drop("df")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + v)) in exact arithmetic; null for v = 0."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.when(v > 0, F.lit(1).cast("long") + F.call_function("div", whole, F.when(v > 0, total + v).cast("decimal(20,0)")))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def exact_share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 1) / whole); in Python numbers where the product exceeds 64 bits."""
    if n.max(initial=0) < 2**63 // SCALE - 1:
        return 1 + SCALE * (n + 1) // whole
    return np.array([1 + SCALE * (int(a) + 1) // int(b) for a, b in zip(n, whole, strict=True)], dtype=np.int64)


def pair_sums(entries: pa.Table, sources: pa.Table) -> np.ndarray:
    """Entry [i, j]: the sum of f over the terms of ``entries``, p of source i against q of source j.

    ``entries`` has per term the list ``at`` of (source, n); ``sources`` has each source's name, its
    count ``whole`` of kept terms plus V, and the share ``p0`` of a term it lacks.
    """
    names, whole, base = sources["source"].combine_chunks(), sources["whole"].to_numpy(), sources["p0"].to_numpy()
    sums = np.zeros((len(base), len(base)), dtype=np.int64)
    for batch in entries.select(["at"]).to_batches(max_chunksize=4096):
        lists = batch.column(0)
        flat = lists.flatten()
        p = np.tile(base, (len(lists), 1))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        p[row, at] = exact_share(flat.field("n").to_numpy(), whole[at])
        for i in range(len(base)):
            gap = p[:, i:i + 1] - p
            sums[i] += (gap * gap // p).sum(axis=0)
    return sums


def _pair_rows(key: tuple, entries: pa.Table, sources: pa.Table) -> pa.Table:
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    sums, tile, names = pair_sums(entries, sources), sources["tile"].to_numpy(), sources["source"].combine_chunks()
    # Inside a tile all pairs; between two tiles those that have one source in each.
    wanted = ~np.eye(len(tile), dtype=bool) if low == high else tile[:, None] != tile[None, :]
    a, b = np.nonzero(wanted & (entries.num_rows > 0))
    return pa.Table.from_arrays([
        pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(sums[a, b]),
        pa.array(np.full(len(a), entries.num_rows, dtype=np.int64))], names=["lang", "source", "item", "value", "seen"])


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every source against each other one of its language.

    ``kept`` is that of ``kept_terms``; ``groups`` has lang, source, whole, p0, v, n_tiles, n_slices. Sources
    fall into tiles by hash, about ``TILE`` each, terms into slices. Terms that neither tile has are not sent: they
    all add the same f of the two absent shares.
    """
    langs = groups.groupBy("lang").agg(F.first("n_slices").alias("n_slices"), F.first("n_tiles").alias("n_tiles"))
    both = F.expr("""array_distinct(flatten(transform(array_distinct(transform(at, x -> pmod(xxhash64(x.source), n_tiles))),
        t -> transform(sequence(0L, n_tiles - 1), u -> struct(least(t, u) as low, greatest(t, u) as high)))))""")
    sent = kept.join(langs, "lang").withColumn("tile", F.explode(both)).select(
        "lang", F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), F.pmod(F.xxhash64("digest", "sub"), F.col("n_slices")).alias("slice"),
        F.expr("CASE WHEN n_tiles = 1 THEN at ELSE filter(at, x -> pmod(xxhash64(x.source), n_tiles) in (tile.low, tile.high)) END").alias("at"))
    sources = groups.where("v > 0").withColumn("tile", F.expr("pmod(xxhash64(source), n_tiles)")).withColumn(
        "other", F.explode(F.expr("sequence(0L, n_tiles - 1)"))).select(
        "lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "source", "whole", "p0", "tile",
        F.explode(F.expr("sequence(0L, n_slices - 1)")).alias("slice"))
    keys = ["lang", "low", "high", "slice"]
    found = sent.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInArrow(_pair_rows, _PAIRS).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # The contract asks for every pair of sources of a language: this many rows are the result.
    one = groups.select("lang", "source", F.col("p0").alias("pa"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("pb"))
    rows = one.join(two, "lang").where("source <> item").join(found, ["lang", "source", "item"], "left")
    unseen = (F.col("v") - F.coalesce("seen", F.lit(0))) * F.coalesce(_divergence(F.col("pa"), F.col("pb")), F.lit(0))
    return rows.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + unseen).alias("value"))


def top_terms(scored: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value) of the ``top`` terms of each group; ties by the item.

    The ``top`` greatest distinct values with their numbers of terms give the least value a kept
    term can have; only terms from there on get their text.
    """
    group = ["lang", "source"]
    best = Window.partitionBy(*group).orderBy(F.desc("value"))
    distinct = scored.groupBy(*group, "value").agg(F.count("*").alias("terms")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = distinct.withColumn("before", before).where(F.col("before") < top).groupBy(*group).agg(F.min("value").alias("least"))
    likely = scored.join(least, group).where("value >= least").join(texts, ["digest", "sub"])
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return likely.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= top).select(*group, F.col("term").alias("item"), "value")


def divergence(docs: DataFrame, *, least_documents: int = 3, top: int = 200, bits: int = 64) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().alias("text"))
    terms, texts = split(staged(counted(rows, bits), "divergence-counts"))
    kept = staged(kept_terms(terms, least_documents), "divergence-kept")
    entries = kept.select("lang", "digest", "sub", "n_lang", F.inline("at"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "total_lang"])
    groups = staged(groups.select(
        "*", (F.col("total") + F.col("v")).alias("whole"), share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("p0"),
        F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).alias("n_tiles"),
        F.greatest(F.ceil(F.col("v") / SLICE), F.lit(1)).alias("n_slices")), "divergence-groups")
    shares = entries.join(groups.select("lang", "source", "total", "v", "total_lang"), ["lang", "source"]).select(
        "lang", "source", "digest", "sub", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    scored = shares.where("p > q").select("lang", "source", "digest", "sub", _divergence(F.col("p"), F.col("q")).alias("value"))
    out = pairs(kept, groups).withColumn("part", F.lit("pair")).unionByName(top_terms(scored, texts, top).withColumn("part", F.lit("term")))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return out.select("lang", "source", "part", "item", "value", F.row_number().over(place).alias("rank"))
