"""Variants as numbered rows: each combination of a product's options is decoded from its ordinal.

No list ever holds the product of the axes. A product's ordinals are cut into blocks, the blocks of
large products are dealt to tasks, and each ordinal is a number in the mixed radix of the axis sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed, keys
from shelfdelta.functions.text import blank_to_null, dashed
from shelfdelta.operators import tiers as tr
from shelfdelta.operators.variants import combination_count
from shelfdelta.schemas import OPTION, TIER

BLOCK = 4096
_DOCUMENT_FIELD = {"print_method": "print_method", "napkin": "napkin_color", "imprint": "imprint_color", "ply_or_size": "ply_or_size"}


def _listed(options: Column, axis: str) -> Column:
    return tr.or_empty(F.try_element_at(options, F.lit(axis)), f"array<{OPTION}>")


def choices(options: Column) -> Column:
    """The options of every axis as variants show them: reference, part of the SKU, price modifier. Made once a product."""
    def shown(axis: str) -> Column:
        return F.transform(_listed(options, axis), lambda o: F.when(o.isNotNull(), F.struct(
            F.struct(o["label"].alias("label"), o["option_value_id"].alias("option_value_id")).alias("ref"),
            F.concat(F.lit(f"|{axis}:"), dashed(o["label"])).alias("part"), F.coalesce(o["price_modifier"], F.lit(0.0)).alias("extra"))))

    return F.struct(*[shown(a).alias(a) for a in fixed.VARIANT_AXES])


def decoded(numbered: DataFrame, axes: str, ordinal: str, head: str, tiers: str, variant: str) -> DataFrame:
    """``numbered`` with the ``variant`` of each ``ordinal`` (from 0): the last axis runs fastest, absent axes are left out.

    ``axes`` are the ``choices`` of the product, ``head`` is the start of its SKUs. All of it is compiled code:
    no lambda runs for a variant.
    """
    later, places = F.lit(1).cast("bigint"), {}
    for axis in reversed(fixed.VARIANT_AXES):
        listed = F.col(axes)[axis]
        size = F.greatest(F.size(listed), F.lit(1))
        # Null where the product has no such axis.
        places[f"_pick_{axis}"] = F.get(listed, (F.call_function("div", F.col(ordinal), later) % size).cast("int"))
        later = later * size
    pick = {a: F.col(f"_pick_{a}") for a in fixed.VARIANT_AXES}
    total = F.lit(0.0)
    for a in fixed.VARIANT_AXES:
        total = total + F.coalesce(pick[a]["extra"], F.lit(0.0))
    # Steps of their own, so that what a caller leaves out of the variant is not computed.
    parts = [F.when(pick[a].isNotNull(), pick[a]["part"]).otherwise("") for a in fixed.VARIANT_AXES]
    rows = numbered.withColumns(places).withColumns({"_sku": F.concat(F.col(head), *parts), "_total": F.round(total, 2)})
    fields = {"variant_key": keys.variant_key(F.col("_sku")), "sku": F.col("_sku"), **{_DOCUMENT_FIELD[a]: pick[a]["ref"] for a in fixed.VARIANT_AXES},
              "price_modifier_total": F.col("_total"), "tiers": F.col(tiers)}
    return rows.withColumn(variant, F.named_struct(*[e for n, v in fields.items() for e in (F.lit(n), v)]))


def variant_rows(products: DataFrame, keep: list[str], options: Column, base_tiers: Column, slug: Column, tag: Column,
                 cap: int | None = None, block: int = BLOCK, ordered: list[str] | None = None) -> DataFrame:
    """``keep`` with ``ordinal`` and ``variant``, a row per combination; one bare row where a product has tiers
    but no axes, none where it has neither. With ``cap`` the first so many of a product.

    Products of one block are expanded where they are; blocks of larger ones are dealt to tasks first.
    Blocks are numbered by a join with the numbers of a block, which keeps their order: rows sorted by ``ordered`` (some of
    ``keep``) stay so, and an aggregate by these columns takes them as they come, where else it would sort all variants.
    """
    head = F.coalesce(blank_to_null(slug), blank_to_null(tag), F.lit("product"))
    rows = products.select(*keep, options.alias("_options"), tr.or_empty(base_tiers, f"array<{TIER}>").alias("_tiers"), dashed(head).alias("_head"),
                           # Where it is read, no filter goes below: options are made once, not for every condition on them.
                           F.monotonically_increasing_id().alias("_place"))
    any_axis = F.lit(False)
    for axis in fixed.VARIANT_AXES:
        any_axis = any_axis | (F.size(_listed(F.col("_options"), axis)) > 0)
    count = combination_count(F.col("_options"))
    rows = rows.filter(any_axis | (F.size("_tiers") > 0)).withColumn("_count", F.least(count, F.lit(cap).cast("bigint")) if cap else count)
    last_block = F.call_function("div", F.col("_count") - 1, F.lit(block))
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    small, large = F.col("_count") <= block, F.col("_count") > block
    dealt = blocks.filter(small).unionByName(blocks.filter(large).hint("rebalance", "_block")).withColumn("_axes", choices(F.col("_options"))).drop("_options")
    if ordered:
        # The optimizer drops a sort below a join unless something between them depends on the order of the rows.
        dealt = dealt.sortWithinPartitions(*ordered, "_place").filter(F.monotonically_increasing_id() >= 0)
    numbers = products.sparkSession.range(0, block, 1, 1).select(F.col("id").alias("_number"))
    numbered = dealt.join(F.broadcast(numbers), F.col("_number") < F.col("_count") - F.col("_block") * block).withColumn(
        "ordinal", F.col("_block") * block + F.col("_number"))
    return decoded(numbered, "_axes", "ordinal", "_head", "_tiers", "variant").select(*keep, "ordinal", "variant")
