"""Text, number and list rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from shelfdelta.functions import fixed
from shelfdelta.functions.binding import let


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def join_list(items: Column, sep: str = "|") -> Column:
    """Non-empty items joined; null and empty lists give ''."""
    return or_blank(F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), sep))


def float_text(c: Column) -> Column:
    """Shortest decimal text of a double, always with a fraction (``13.0``, ``0.05``)."""
    def show(b: Column) -> Column:
        # Java switches to exponents below 1e-3 and from 1e7 on; the sheet does so
        # only below 1e-4 and from 1e16 on.
        spelled = F.rtrim(b["d"].try_cast("decimal(38,20)").cast("string"), F.lit("0"))
        spelled = F.when(spelled.endswith("."), F.concat(spelled, F.lit("0"))).otherwise(spelled)
        exponent = F.regexp_replace(F.regexp_replace(
            F.regexp_replace(b["text"], r"\.0E", "E"), r"E-(\d)$", "e-0$1"), r"E(\d)", "e+$1")
        size = F.abs(b["d"])
        return (F.when(~b["text"].contains("E"), b["text"])
                .when((size >= 1e-4) & (size < 1e16), spelled)
                .otherwise(exponent))

    return let(F.struct(c.try_cast("double").alias("d"), c.try_cast("double").cast("string").alias("text")), show)


def price_text(c: Column) -> Column:
    """A price without a trailing ``.0``; null gives ''."""
    c = c.try_cast("double")
    whole = F.coalesce(c.try_cast("bigint").cast("string"), c.try_cast("decimal(38,0)").cast("string"), float_text(c))
    return or_blank(F.when(c % 1 == 0, whole).otherwise(float_text(c)))


def quantity_text(c: Column) -> Column:
    """Integer text where the value is one, else the value as given; null gives ''."""
    text = c.cast("string")
    return or_blank(F.coalesce(text.try_cast("bigint").cast("string"), text))


def cents_text(cents: Column) -> Column:
    """Cents as a dollar text (``1385`` → ``13.85``); null gives ''."""
    return or_blank(float_text(cents.try_cast("bigint") / F.lit(100.0)))


def cents_amount(cents: Column) -> Column:
    """Cents as dollars; null and zero give null."""
    return F.when(cents != 0, cents / F.lit(100.0))


def money(c: Column) -> Column:
    """``$1,234.5`` → 1234.5; empty gives 0, anything else unreadable 0."""
    cleaned = strip(F.regexp_replace(c.cast("string"), r"[$,]", ""))
    return F.coalesce(blank_to_null(cleaned).try_cast("double"), F.lit(0.0))


def cell(c: Column, dtype: T.DataType) -> Column:
    """A sheet cell, chosen by the column's type at plan time."""
    if isinstance(dtype, T.ArrayType):
        return join_list(F.transform(c, lambda x: cell(x, dtype.elementType)))
    if isinstance(dtype, T.BooleanType):
        return or_blank(F.when(c, "true").when(~c, "false"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return or_blank(float_text(c))
    if isinstance(dtype, (T.StructType, T.MapType)):
        return or_blank(F.to_json(c))
    return or_blank(c.cast("string"))


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def dashed(c: Column) -> Column:
    """Spaces and slashes to dashes, as variant SKUs need."""
    return F.translate(c, " /", "--")


def shape_part(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit("in")), F.lit(" "), F.lit("-"))


def size_part(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit("in")), F.lit(" "), F.lit(""))


def any_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds any of the phrases."""
    return let(F.lower(c), lambda low: reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]))


def option_group(label: Column) -> Column:
    """The group of an option step heading; the first listed group wins."""
    def choose(low: Column) -> Column:
        out = F
        for group, phrases in fixed.GROUP_PHRASES:
            out = out.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), F.lit(group))
        return out.otherwise(F.lit("other"))
    return let(F.lower(or_blank(label)), choose)


def material_word(c: Column) -> Column:
    """The first listed material the text mentions, title-cased."""
    def choose(low: Column) -> Column:
        out = F
        for word in fixed.MATERIAL_WORDS:
            out = out.when(low.contains(word), F.lit(word.title()))
        return out.otherwise(F.lit(None).cast("string"))
    return let(F.lower(c), choose)


def labelled_line(c: Column, label: str, colon_required: bool = True) -> Column:
    """The rest of the line after ``label:`` (any case), or null."""
    gap = r"\s*:\s*" if colon_required else r"\s*:?\s*"
    return blank_to_null(strip(F.regexp_extract(c, f"(?i){label}{gap}([^\\n]+)", 1)))


def dimension_text(c: Column, longest: int | None = None) -> Column:
    """The first ``A x B unit`` phrase of 4 characters and more (``longest`` at most, where given), or null."""
    patterns = [
        r"(?i)(\d+\.?\d*\s*(?:x|×)\s*\d+\.?\d*\s*(?:in|inch|cm|mm|ft))",
        r"(?i)(\d+\s*(?:in|inch)\s*(?:x|×)\s*\d+\s*(?:in|inch))",
    ]

    def fitting(text: Column, pattern: str) -> Column:
        return let(strip(F.regexp_extract(text, pattern, 1)),
                   lambda hit: F.when((F.length(hit) > 3) & ((F.length(hit) <= longest) if longest else F.lit(True)), hit))

    return let(c, lambda text: F.coalesce(*[fitting(text, p) for p in patterns]))


def clean_description(text: Column, title: Column, limit: int | None = None) -> Column:
    """Drop a leading title, cut at SPECIFICATIONS, keep texts of 11 characters and more, whole unless ``limit`` is given."""
    def untitled(b: Column) -> Column:
        led = (b["title"] != "") & F.startswith(b["text"], b["title"])
        return F.when(led, strip(F.substring(b["text"], F.length(b["title"]) + 1, F.length(b["text"])))
                      ).otherwise(b["text"])

    def cut(body: Column) -> Column:
        return F.when(F.instr(body, "SPECIFICATIONS") > 1,
                      strip(F.regexp_replace(body, r"(?s)SPECIFICATIONS.*$", ""))).otherwise(body)

    def kept(b: Column) -> Column:
        return let(let(untitled(b), cut), lambda out: F.when(
            (F.length(b["text"]) >= 30) & (F.length(out) > 10), F.left(out, F.lit(limit)) if limit else out))

    return let(F.struct(text.alias("text"), or_blank(title).alias("title")), kept)


def colour_list(text: Column, limit: int | None = None) -> Column:
    """Split a colour text on its separators, first occurrence kept, all unless ``limit`` is given."""
    def pick(b: Column) -> Column:
        # One long run-on word list falls back to capitalised words.
        words = F.regexp_extract_all(b["text"], F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"), F.lit(1))
        chosen = F.when((F.size(b["parts"]) <= 1) & (F.length(F.get(b["parts"], F.lit(0))) > 40), words
                        ).otherwise(b["parts"])
        found = F.array_distinct(F.filter(chosen, lambda x: x != ""))
        return F.slice(found, 1, limit) if limit else found

    def split(whole: Column) -> Column:
        parts = F.transform(F.split(whole, r"[\n,•/;]+"), lambda x: strip(x))
        return let(F.struct(whole.alias("text"), parts.alias("parts")), pick)

    return let(text, split)


def main_image(images: Column) -> Column:
    return F.get(images, F.lit(0))


def gallery(images: Column) -> Column:
    return F.slice(images, F.lit(2), F.greatest(F.size(images), F.lit(1)))


def country_code(c: Column) -> Column:
    """A country name as its two-letter code where known, else the trimmed name."""
    name = strip(or_blank(c))
    known = F.create_map(*[F.lit(x) for pair in fixed.COUNTRY_CODES.items() for x in pair])
    return (F.when(F.try_element_at(known, name).isNotNull(), F.try_element_at(known, name))
            .when(name.rlike(r"^\p{L}{2}$"), F.upper(name))
            .otherwise(name))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction is shown only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def last_days(as_of: Column, days: int) -> Column:
    """The lower bound of a look-back of ``days`` from an explicit moment."""
    return as_of - F.make_interval(days=F.lit(days))


def day_start(as_of: Column) -> Column:
    return F.date_trunc("DAY", as_of)
