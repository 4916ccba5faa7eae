"""Filter interaction audit: what each filter removes in every order of applying them.

Each text is judged once by all five filters; its failures are a mask of five bits. Rows are
counted per part and mask (at most 32 cells a part), and only cells go on. Each cell is folded
across the array of the 120 orders (``transform`` over orders, ``aggregate`` over the steps of
one) into 600 structs weighted with the cell's counts, and the cells of a part are merged by
elementwise sums. No user function runs.

Failure conditions: A has under 50 words; B has 100 * distinct words < 65 * words; C has
100 * ``[A-Z]`` > 5 * code points; D holds one of ``#$%&*|``; E is identical to the text of any
smaller doc_id of the whole table.

Defined results: a null text is empty, a null source the empty string; of rows that repeat a
doc_id none makes the other fail E; a null doc_id is smaller than none and larger than none, so it
neither fails E nor makes others fail, and has no label; a document is good (toxic) if any of its
label rows says so; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfdelta.functions.binding import let
from shelfdelta.llm.common import text_or_empty
from shelfdelta.llm.quality_table import words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
_SALTS = 1024


def own_failures(text: Column) -> Column:
    """Mask of the filters that look at one text alone (A to D)."""
    def bit(name: str, fails: Column) -> Column:
        return F.when(fails, _BIT[name]).otherwise(0)

    def of_sizes(s: Column) -> Column:
        upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
        return (bit("A", s["words"] < 50) + bit("B", F.lit(100) * s["different"] < F.lit(65) * s["words"])
                + bit("C", F.lit(100) * upper.cast("long") > F.lit(5) * F.length(text)) + bit("D", text.rlike(r"[#$%&*|]")))

    return let(words_of(text), lambda w: let(F.struct(
        F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("different")), of_sizes))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail."""
    text = text_or_empty()
    judged = docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("mask"))
    # Repeated rows collapse before anything is joined.
    rows = judged.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"))
    # Rows without an id meet no label; a salt keeps them from one task.
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SALTS))).otherwise(F.lit(0).cast("long")))
    marked = salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").na.fill(0, ["is_good", "is_toxic"])
    # A text shared by any number of documents is one row per part and label here.
    per_text = marked.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)) + F.col("n_null")
    split = per_text.withColumn("least", least).withColumn("unseen", F.coalesce(firsts, F.col("n_null")))
    both = split.select("part", "is_good", "is_toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("unseen").alias("n")),
        F.struct((F.col("mask") + _BIT["E"]).alias("mask"), (F.col("n") - F.col("unseen")).alias("n")))))
    return both.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))


def _orders() -> Column:
    """The orders as arrays of filter bits."""
    return F.array(*[F.array(*[F.lit(_BIT[x]) for x in order]) for order in ORDERS])


def _hit(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def _firsts(cell: Column, orders: Column) -> Column:
    """Per filter bit, in how many orders it is the one that removes the cell."""
    def remover(order: Column) -> Column:
        return F.aggregate(order, F.lit(0), lambda found, bit: F.when((found == 0) & _hit(cell["mask"], bit), bit).otherwise(found))

    def times(removers: Column, bit: int) -> Column:
        return F.size(F.filter(removers, lambda r: r == bit)).cast("long")

    return let(F.transform(orders, remover), lambda removers: F.map_from_arrays(
        F.array(*[F.lit(b) for b in _BIT.values()]), F.array(*[times(removers, b) for b in _BIT.values()])))


def folded(cell: Column, orders: Column) -> Column:
    """600 structs of counts, order by order and step by step, of one cell (mask, n, good, toxic)."""
    def weighted(state: Column, bit: Column, firsts: Column) -> Column:
        fails, gone = _hit(cell["mask"], bit), state["gone"]

        def counted(test: Column, what: str = "n") -> Column:
            return F.when(test, cell[what]).otherwise(F.lit(0).cast("long"))

        removes = fails & ~gone
        values = (counted(~fails & ~gone), counted(removes), counted(fails & gone), counted(cell["mask"] == bit), counted(removes, "good"),
                  counted(removes, "toxic"), cell["n"] * F.element_at(firsts, bit))
        step = F.struct(*[v.alias(c) for v, c in zip(values, COUNTS, strict=True)])
        return F.struct(F.concat(state["steps"], F.array(step)).alias("steps"), (gone | fails).alias("gone"))

    def of_order(order: Column, firsts: Column) -> Column:
        start = F.struct(F.lit([]).cast(_STEPS).alias("steps"), F.lit(False).alias("gone"))
        return F.aggregate(order, start, lambda state, bit: weighted(state, bit, firsts), lambda state: state["steps"])

    return let(_firsts(cell, orders), lambda firsts: F.flatten(F.transform(orders, lambda order: of_order(order, firsts))))


_STEPS = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: the counts of ``COUNTS``."""
    def added(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(FILTERS))
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    sums = let(_orders(), lambda orders: F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, folded(cell, orders), added)))
    rows = parts.select("part", F.posexplode(sums).alias("at", "counts"))
    name = F.element_at(F.array(*[F.lit(x) for x in ORDERS]), (F.col("at") / len(FILTERS)).cast("int") + 1)
    return rows.select("part", name.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
                       *[F.col("counts")[c].alias(c) for c in COUNTS])
