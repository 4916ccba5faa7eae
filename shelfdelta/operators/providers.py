"""API-catalog records: blueprint × provider × variant, with option and shipping
look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed
from shelfdelta.functions import predicates as W
from shelfdelta.functions.binding import let
from shelfdelta.functions.text import cents_amount, country_code


def min_shipping(entries: Column) -> Column:
    """Cheapest first-item rate to the US, else the cheapest of all."""
    rate = lambda es: F.array_min(F.transform(es, lambda e: e["rate_first"]))
    return F.coalesce(rate(F.filter(entries, lambda e: e["country"].isin(fixed.US_NAMES))), rate(entries))


def min_shipping_by(rates: DataFrame, *by: str) -> DataFrame:
    """The same rule over a rate table ``(…, country, rate_first)``."""
    us = F.col("country").isin(fixed.US_NAMES)
    return rates.groupBy(*by).agg(F.coalesce(
        F.min(F.when(us, F.col("rate_first"))), F.min("rate_first")).alias("min_shipping_cents"))


def allowed_providers(providers: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Providers inside the country allow-list, with their code. Applied before the
    variant fan-out so that excluded providers are never expanded."""
    return providers.filter(W.allowed_country("country", allowed)).withColumn(
        "country_iso", country_code(F.col("country")))


def option_lookup(option_groups: Column) -> Column:
    """``array<struct<type, items>>`` as a flat list of (id, type, label, hex)."""
    return F.flatten(F.transform(option_groups, lambda g: F.transform(
        F.filter(g["items"], lambda i: i["id"].isNotNull()), lambda i: F.struct(
            i["id"].alias("id"), g["type"].alias("type"), F.coalesce(i["label"], F.lit("")).alias("label"),
            F.coalesce(F.get(i["colors"], F.lit(0))["hex"], F.lit("")).alias("hex")))))


def by_option(lookup: Column, kinds: tuple[str, ...] = ("color", "size")) -> Column:
    """The look-up as ``struct<ids, entries, <kind>…>``, made once per offer: ids and entries latest
    first, and the ids that have each kind."""
    def ids_of(entries: Column) -> Column:
        return F.transform(entries, lambda e: e["id"])

    def of_kind(entries: Column, kind: str) -> Column:
        return F.filter(entries, lambda e: e["type"] == kind)

    def lists(latest: Column) -> Column:
        return F.struct(ids_of(latest).alias("ids"), latest.alias("entries"), *[ids_of(of_kind(latest, k)).alias(k) for k in kinds])

    return let(F.reverse(lookup), lists)


def chosen_option(option_ids: Column, found: Column, kind: str) -> Column:
    """The last of a variant's options that has the given type; ``found`` is ``by_option``.

    A later entry for the same id replaces an earlier one.
    """
    last = F.try_element_at(F.filter(option_ids, lambda o: F.array_contains(found[kind], o)), F.lit(-1))
    return F.get(found["entries"], (F.array_position(found["ids"], last) - 1).cast("int"))


def variant_options(variant_options_df: DataFrame, options: DataFrame, key: list[str]) -> DataFrame:
    """The relational form: ``(key…, pos, option_id)`` with ``(option_id, type, label, hex)``
    gives color and size columns, the last option of each type winning."""
    joined = variant_options_df.join(options, "option_id")
    pick = lambda kind, c: F.coalesce(F.max_by(
        F.when(F.col("type") == kind, F.col(c)), F.when(F.col("type") == kind, F.col("pos"))), F.lit(""))
    return joined.groupBy(*key).agg(pick("color", "label").alias("color_label"),
                                    pick("color", "hex").alias("color_hex"),
                                    pick("size", "label").alias("size_label"))


def variant_records(blueprints: DataFrame, offers: DataFrame, providers: DataFrame,
                    allowed: list[str] | None = None) -> DataFrame:
    """One record per blueprint × allowed provider × variant.

    ``blueprints``: blueprint_id, title, brand, category, tags, images. ``offers``:
    blueprint_id, provider_id, min_price, options, min_shipping, variants.
    ``providers``: provider_id, name, country, scoring.
    """
    kept = allowed_providers(providers, allowed).select(
        "provider_id", F.col("name").alias("_provider"), F.col("country").alias("provider_country"),
        F.col("scoring").alias("provider_scoring"))
    rows = offers.join(kept, "provider_id").join(blueprints, "blueprint_id")
    rows = rows.withColumn("_lookup", by_option(option_lookup(F.col("options")))).withColumn(
        "min_shipping_cents", min_shipping(F.col("min_shipping")))
    wide = rows.select(*rows.columns, F.explode("variants").alias("v"))
    cost = F.coalesce(F.get("v.costs", F.lit(0))["result"], F.col("v.cost"), F.lit(0))
    sub = F.coalesce(F.get("v.costs", F.lit(0))["result_subscription"], F.col("v.cost_subscription"))
    wide = wide.withColumn("_color", chosen_option(F.col("v.options"), F.col("_lookup"), "color")).withColumn(
        "_size", chosen_option(F.col("v.options"), F.col("_lookup"), "size"))
    name = F.coalesce("_provider", F.concat(F.lit("Provider "), F.col("provider_id").cast("string")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return wide.select(
        F.format_string("bp%d_p%d_v%d", "blueprint_id", "provider_id", "v.id").alias("product_id"),
        "blueprint_id", "provider_id", F.col("v.id").alias("variant_id"), "title",
        F.lit("").alias("description"), "brand", "category", "tags", name.alias("provider_name"),
        "provider_country", "provider_scoring",
        blank(F.col("_color.label")).alias("color_label"), blank(F.col("_color.hex")).alias("color_hex"),
        blank(F.col("_size.label")).alias("size_label"),
        cost.alias("price_cents"), cents_amount(cost).alias("price_usd"),
        sub.alias("price_subscription_cents"), cents_amount(sub).alias("price_subscription_usd"),
        F.col("min_price").alias("min_price_cents"), cents_amount(F.col("min_price")).alias("min_price_usd"),
        "min_shipping_cents", cents_amount(F.col("min_shipping_cents")).alias("min_shipping_usd"),
        blank(F.col("v.status")).alias("status"),
        F.coalesce("v.available", F.lit(False)).alias("available"), "images", F.lit("printify").alias("source"))


def provider_records(blueprints: DataFrame, offers: DataFrame, providers: DataFrame,
                     allowed: list[str] | None = None) -> DataFrame:
    """The summary mode: one record per blueprint × allowed provider."""
    kept = allowed_providers(providers, allowed).select(
        "provider_id", F.col("name").alias("_provider"), F.col("country").alias("provider_country"))
    rows = offers.join(kept, "provider_id").join(blueprints, "blueprint_id")
    shipping = min_shipping(F.col("min_shipping"))
    price = F.coalesce("min_price", F.lit(0))
    return rows.select(
        F.format_string("bp%d_p%d", "blueprint_id", "provider_id").alias("product_id"),
        "blueprint_id", "provider_id", F.lit(None).cast("bigint").alias("variant_id"), "title", "brand",
        "category", "tags", F.coalesce("_provider", F.concat(
            F.lit("Provider "), F.col("provider_id").cast("string"))).alias("provider_name"),
        "provider_country", price.alias("price_cents"), cents_amount(price).alias("price_usd"),
        price.alias("min_price_cents"), cents_amount(price).alias("min_price_usd"),
        shipping.alias("min_shipping_cents"), cents_amount(shipping).alias("min_shipping_usd"),
        F.lit("available").alias("status"), F.lit(True).alias("available"), "images",
        F.lit("printify").alias("source"))
