"""URL handling. Path work uses regular expressions: stored links are often not
valid URIs, and ``parse_url`` rejects those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from shelfdelta.functions import fixed
from shelfdelta.functions.text import blank_to_null, or_blank


def canonical(url: Column) -> Column:
    """Without query, fragment and (below the host) trailing slashes."""
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    slashes = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    return F.when(bare.endswith("/") & (slashes > 3), F.rtrim(bare, F.lit("/"))).otherwise(bare)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def resolve(link: Column, base: Column) -> Column:
    """An href as an absolute URL, seen from the page it was found on."""
    bare_base = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.when(path(base) == "", F.concat(origin(base), F.lit("/"))).otherwise(
        F.regexp_replace(bare_base, r"[^/]*$", ""))
    return (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), link))
            .when(link.startswith("/"), F.concat(origin(base), link))
            .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), link))
            .when(link.startswith("?"), F.concat(bare_base, link))
            .when(link == "", base)
            .otherwise(F.concat(folder, link)))


def is_product(url: Column, host: Column | str, excluded: list[str] | None = None,
               root: str = "product") -> Column:
    """Under the host, on no excluded path, three or more segments, the first the root."""
    host = F.lit(host) if isinstance(host, str) else host
    banned = reduce(lambda a, b: a | b,
                    [url.contains(p) for p in (excluded or fixed.NON_PRODUCT_PATHS)])
    parts = segments(url)
    return url.contains(host) & ~banned & (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == root)


def is_category_root(url: Column, host: Column | str, root: str = "product") -> Column:
    host = F.lit(host) if isinstance(host, str) else host
    parts = segments(url)
    return url.contains(host) & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == root)


def subtype(url: Column, markers: list[str] | None = None) -> Column:
    deal = reduce(lambda a, b: a | b, [url.contains(m) for m in (markers or fixed.DEAL_MARKERS)])
    return F.when(deal, "deal").otherwise("standard")


def slug(url: Column) -> Column:
    """The last path segment, ``product`` where there is none."""
    return F.coalesce(
        blank_to_null(F.element_at(F.split(F.rtrim(or_blank(url), F.lit("/")), "/"), -1)), F.lit("product"))


def segment_title(url: Column, index: int) -> Column:
    """A path segment as a heading (``paper-cups`` → ``Paper Cups``); null where absent."""
    return F.initcap(F.replace(F.get(segments(url), F.lit(index)), F.lit("-"), F.lit(" ")))


def size_in_url(url: Column) -> Column:
    """``18x24`` anywhere, else the ``variant=`` query value."""
    return F.coalesce(blank_to_null(F.regexp_extract(url, r"(\d+x\d+)", 1)),
                      blank_to_null(F.regexp_extract(url, r"variant=([^&]+)", 1)))


def id_in_url(url: Column) -> Column:
    """The upper-case product code that ends the path."""
    return blank_to_null(F.regexp_extract(url, r"/([A-Z]+\d+|CUSTOM)(?:\?|$)", 1))


def image_allowed(url: Column, deny: list[str] | None = None) -> Column:
    low = F.lower(url)
    return (url != "") & ~reduce(lambda a, b: a | b,
                                 [low.contains(p) for p in (deny or fixed.IMAGE_DENY)])
