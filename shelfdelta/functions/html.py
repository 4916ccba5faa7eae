"""Reading HTML with column expressions.

Elements are found by regular expressions and, where they nest, by counting the
opening and closing tags of their kind. All of it runs JVM-side on the whole page
text; no page leaves its row.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from shelfdelta.functions.binding import let
from shelfdelta.functions.text import blank_to_null, strip

# The entities that occur in practice, for SQL twins; ``&amp;`` must come last there.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&times;", "×"), ("&amp;", "&"),
]


# Elements that never have content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def markup(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")


def _named() -> Column:
    """Every named entity of the standard, as one constant map, the usual ones first."""
    usual = {e[1:-1]: char for e, char in ENTITIES if "#" not in e}
    rest = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps({**usual, **{k: v for k, v in rest.items() if k not in usual}}, ensure_ascii=False)), "map<string,string>")


def _decoded(piece: Column) -> Column:
    """A piece that began with an ampersand, its entity replaced where it is one."""
    code = F.substring_index(piece, ";", 1)
    n = F.when(code.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(code, 3, 8), 16, 10)).when(
        code.rlike("^#[0-9]{1,7}$"), F.substring(code, 2, 8)).try_cast("int")
    valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    char = F.when(piece.startswith("#"), numeric).otherwise(F.try_element_at(_named(), code))
    rest = F.substring(piece, F.length(code) + 2, F.length(piece))
    return F.coalesce(F.when(piece.contains(";"), F.concat(char, rest)), F.concat(F.lit("&"), piece))


def unescape(text: Column) -> Column:
    """Entities as characters, each once. One lambda deep: the callers nest, and the analyzer's rounds are limited."""
    return F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(_decoded(p))), "")


def node_text(fragment: Column, sep: str = "") -> Column:
    """The text nodes of a fragment, each stripped, joined with ``sep``."""
    parts = F.transform(F.split(fragment, "<[^>]*>"), lambda x: strip(unescape(x)))
    return F.array_join(F.filter(parts, lambda x: x != ""), sep)


def inner(html: Column, tag: str, attrs: str = "") -> Column:
    """Inner HTML of the first ``tag`` that does not nest, '' when absent."""
    look = f"(?=[^>]*{attrs})" if attrs else ""
    return F.regexp_extract(html, rf"(?is)<{tag}\b{look}[^>]*>(.*?)</{tag}\s*>", 1)


def all_outer(html: Column, tag: str, attrs: str = "") -> Column:
    """Every non-nesting ``tag`` with its content, in page order."""
    look = f"(?=[^>]*{attrs})" if attrs else ""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b{look}[^>]*>.*?</{tag}\s*>)"), F.lit(1))


def all_tags(html: Column, tag: str, attrs: str) -> Column:
    """Every opening ``tag`` whose attributes match."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b(?=[^>]*{attrs})[^>]*>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag text; null when absent or empty."""
    found = F.regexp_extract(tag, rf"""(?is)^<[^>]*?\s{name}\s*=\s*(["'])(.*?)\1""", 2)
    return blank_to_null(unescape(found))


def has_class(name: str) -> str:
    return rf"""\bclass\s*=\s*["'][^"']*(?<![\w-]){name}(?![\w-])"""


def has_id(name: str) -> str:
    return rf"""\bid\s*=\s*["']{name}["']"""


def _own(pieces: Column, start: Column, of_kind=None) -> Column:
    """The text from piece ``start`` (0-based), an opening tag, up to and including its own closing
    tag; ``pieces`` are cut in front of tags. Null where no such tag comes."""
    of_kind = of_kind or (lambda piece: F.lit(True))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("closed"))

    def walk(acc: Column, piece: Column) -> Column:
        closing = piece.startswith("</") & of_kind(piece)
        opening = piece.startswith("<") & ~piece.startswith("</") & of_kind(piece)
        depth = acc["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct(
            depth.alias("depth"), (acc["taken"] + 1).alias("taken"),
            (closing & (depth <= 0)).alias("closed")))

    def text(acc: Column) -> Column:
        last = F.regexp_extract(F.get(pieces, start + acc["taken"] - 1), r"^(</[^>]*>)", 1)
        return F.when(acc["closed"], F.concat(F.array_join(F.slice(pieces, start + 1, acc["taken"] - 1), ""), last))

    return F.aggregate(F.slice(pieces, start + 1, F.size(pieces)), zero, walk, text)


def element(html: Column, tag: str, attrs: str) -> Column:
    """The first ``tag`` with matching attributes, up to its own closing tag, nested
    tags of the same kind included, up to the end where it is never closed; '' when absent."""
    tail = F.regexp_extract(html, rf"(?is)(<{tag}\b(?=[^>]*{attrs})[^>]*>.*)$", 1)
    return let(F.split(tail, rf"(?i)(?=</?{tag}\b)"), lambda ps: F.coalesce(_own(ps, F.lit(0)), F.array_join(ps, "")))


def elements(html: Column, attrs: str) -> Column:
    """Every element, of any kind and however nested, whose opening tag has ``attrs``, in page order.

    Most hold no tag of their own kind and none with ``attrs``: one pattern reads those. Only
    the others are walked through. An element that is never closed is its tag alone.
    """
    def whole(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            plain = F.regexp_extract(part, r"(?is)^(<(\w+)\b[^>]*>(?:.*?</\2\s*>)?)", 1)
            kind = F.lower(F.regexp_extract(part, r"^<(\w+)", 1))
            simple = (F.instr(F.lower(F.substring(plain, F.lit(2), F.length(plain))), F.concat(F.lit("<"), kind)) == 0) & (
                F.lower(plain).endswith(">") & F.lower(plain).contains(F.concat(F.lit("</"), kind)) | kind.isin(*VOID))
            tags = F.split(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""), "(?=<)")
            walked = let(tags, lambda ts: _own(ts, F.lit(0), lambda t: F.lower(F.regexp_extract(t, r"^</?(\w+)", 1)) == kind))
            return F.when(simple, plain).otherwise(F.coalesce(walked, plain))

        return F.filter(F.transform(parts, lambda part, i: F.when(
            part.rlike(rf"(?is)^<\w+\b(?=[^>]*{attrs})"), one(part, i))), lambda e: e.isNotNull())

    return let(F.split(html, rf"(?is)(?=<\w+\b[^>]*{attrs})"), whole)


def rows_of(table: Column) -> Column:
    """The rows of a table fragment, each from its ``<tr`` on."""
    return F.filter(F.split(table, r"(?i)(?=<tr\b)"), lambda r: r.rlike(r"(?i)^<tr\b"))


def cells_of(row: Column) -> Column:
    """The cells of a row, with their tags; an unclosed cell ends at the next one or with the row."""
    return F.regexp_extract_all(row, F.lit(r"(?is)(<t[hd]\b[^>]*>.*?(?:</t[hd]\s*>|(?=<t[hd]\b)|$))"), F.lit(1))


def tables_of(html: Column) -> Column:
    """Every table, also those inside others, each up to its own closing tag, in page order."""
    def found(pieces: Column) -> Column:
        return F.filter(F.transform(pieces, lambda p, i: F.when(p.rlike(r"(?i)^<table\b"), _own(pieces, i))), lambda t: t.isNotNull())
    return let(F.split(html, r"(?i)(?=</?table\b)"), found)
