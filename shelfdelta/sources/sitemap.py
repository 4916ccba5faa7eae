"""Sitemaps held as text: ``(url, body)`` rows, one per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.functions import urls as U
from shelfdelta.functions.predicates import sitemap_priority
from shelfdelta.functions.text import strip
from shelfdelta.operators.diff import first_per_key
from shelfdelta.session import cut_lineage

_LEAF = "url array<struct<loc:string,lastmod:string,priority:string>>"
_INDEX = "sitemap array<struct<loc:string>>"


def is_index(body: Column) -> Column:
    return body.rlike(r"(?is)<(?:\w+:)?sitemapindex\b")


def entries(sitemaps: DataFrame) -> DataFrame:
    """``url, lastmod, priority, sitemap, pos`` of every entry of url-set files; a
    missing or unreadable priority is 0.8. Unreadable files give no rows."""
    parsed = F.from_xml(F.col("body"), _LEAF, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    rows = sitemaps.filter(~is_index(F.col("body"))).select(
        F.col("url").alias("sitemap"), F.posexplode(parsed["url"]).alias("pos", "e"))
    return rows.filter(F.col("e.loc").isNotNull() & (F.col("e.loc") != "")).select(
        strip(F.col("e.loc")).alias("url"), F.col("e.lastmod").alias("lastmod"),
        sitemap_priority(F.col("e.priority")).alias("priority"), "sitemap", "pos")


def reachable(sitemaps: DataFrame, root: str | Column, max_depth: int | None = None) -> DataFrame:
    """Files reached from the root (a URL, or a predicate for several) through index
    files, with the first level each is found on.

    The walk goes over (file, child) pairs of URLs, level by level until no new file
    turns up, so cycles end it too; bodies are joined once at the end. ``max_depth``
    stops it earlier.
    """
    parsed = F.from_xml(F.col("body"), _INDEX, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    pairs = cut_lineage(sitemaps.filter(is_index(F.col("body"))).select("url", F.explode(parsed["sitemap"]).alias("s")).select(
        F.col("url").alias("parent"), strip(F.col("s.loc")).alias("url")).distinct(), "sitemap-pairs")
    chosen = F.col("url") == root if isinstance(root, str) else root
    seen = level = cut_lineage(sitemaps.filter(chosen).select("url").distinct().withColumn("depth", F.lit(0)), "sitemap-level")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = pairs.join(level.select(F.col("url").alias("parent")), "parent", "left_semi").select("url").distinct()
        level = cut_lineage(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "sitemap-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return sitemaps.join(seen, "url").select("url", "depth", "body").dropDuplicates(["url"])


def product_entries(found: DataFrame, host: str | Column, root: str = "product") -> DataFrame:
    """Product pages among sitemap entries: canonical URLs, category roots cut by
    their priority, the first entry of each URL."""
    rows = found.withColumn("url", U.canonical(F.col("url"))).filter(
        U.is_product(F.col("url"), host, root=root) & (F.col("priority") < 1.0))
    return first_per_key(rows, "url", ["sitemap", "pos"]).withColumn("source", F.lit("sitemap"))


def shop_entries(found: DataFrame, marker: str = "/shop/") -> DataFrame:
    """The plain rule of shops that mark product URLs with a path part."""
    return found.filter(F.col("url").contains(marker))
