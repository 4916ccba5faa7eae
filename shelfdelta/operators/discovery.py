"""URL discovery: sitemaps, link harvest, precedence union, lastmod skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import fixed, payload as P, urls as U
from shelfdelta.functions.html import markup
from shelfdelta.functions.predicates import sitemap_priority
from shelfdelta.functions.text import strip
from shelfdelta.operators.diff import first_per_key

ORIGINS = ["sitemap", "homepage", "category"]


def by_precedence(found: DataFrame) -> DataFrame:
    """One row per URL: the best origin, there the first place.

    ``found`` has ``url, source, place`` (place orders rows inside an origin) and
    any further columns. Copies of a URL collapse on the map side.
    """
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("source")).cast("int")
    ranked = found.withColumn("_rank", rank)
    return first_per_key(ranked, "url", ["_rank", "place"]).drop("_rank").withColumn(
        "product_subtype", U.subtype(F.col("url")))


def discovery_counters(discovered: DataFrame) -> DataFrame:
    return discovered.groupBy("source", "product_subtype").agg(F.count("*").alias("n"))


def links(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Every ``a[href]`` of every page as a canonical absolute URL, in page order."""
    # Quoted values may hold ">"; values need no quotes.
    tags = F.regexp_extract_all(markup(F.col(html)), F.lit(r"""(?i)<a\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""), F.lit(1))
    value = r"""(?is)(?:^|["'\s])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    hrefs = F.transform(F.filter(tags, lambda t: t.rlike(value)), lambda t: F.concat(*[F.regexp_extract(t, value, g) for g in (1, 2, 3)]))
    return pages.select(F.col(key).alias("page"), F.col(url).alias("base"),
                        F.posexplode(hrefs).alias("pos", "href")).select(
        "page", "pos", "href", U.canonical(U.resolve(F.col("href"), F.col("base"))).alias("url"))


def lastmod_split(discovered: DataFrame, stored: DataFrame, force: bool = False,
                  hidden: list[str] | None = None) -> DataFrame:
    """Discovered URLs with ``action`` = skip or fetch, and the stored payload of the
    skipped ones without its storage fields, ready to re-enter the run.

    Skipping needs a sitemap date, a stored document of schema version 2 or later,
    and the same date stored with it.
    """
    known = stored.select(F.col("product_url").alias("url"), F.col("schema_version").alias("_version"), F.col("lastmod").alias("_lastmod"))
    joined = discovered.join(known, "url", "left")
    date = F.nullif(strip(F.coalesce("lastmod", F.lit(""))), F.lit(""))
    same = (F.lit(not force) & date.isNotNull() & (F.coalesce("_version", F.lit(1)) >= 2)
            & (date == strip(F.coalesce("_lastmod", F.lit("")))))
    decided = joined.select(*discovered.columns, F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("fetch").alias("action"))
    # Only payloads of skipped URLs go into the second join.
    skipped = decided.filter(F.col("action") == "skip").select("url").distinct()
    bodies = stored.select(F.col("product_url").alias("url"), P.without(F.col("payload"), hidden or [
        f for f in fixed.STORAGE_FIELDS if f != "deleted_by_task"]).alias("reused")).join(skipped, "url", "left_semi")
    return decided.join(bodies, "url", "left").select(*discovered.columns, "action", F.when(F.col("action") == "skip", F.col("reused")).alias("reused"))


def merged_run(fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """Fetched rows and unchanged skipped rows as one run."""
    return fetched.unionByName(skipped, allowMissingColumns=True)


def crawl_counters(outcomes: DataFrame, by: str = "outcome") -> DataFrame:
    return outcomes.groupBy(by).agg(F.count("*").alias("n"))


def priority_cut(priority_text: Column) -> Column:
    """Category roots carry priority 1.0 and are left out."""
    return sitemap_priority(priority_text) < 1.0
