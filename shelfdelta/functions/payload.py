"""Product payloads: maps of top-level field → canonical JSON text.

A map keeps the difference between a missing field and a field that is null,
which the diff needs. ``from_json`` with a variant value type keeps the JSON type
of every value, and a variant prints with sorted keys, so equal documents have
equal text whatever order their keys came in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfdelta.functions import fixed
from shelfdelta.functions.binding import let

DIFF_TYPE = ("struct<added_fields:map<string,string>,removed_fields:map<string,string>,"
             "changed_fields:map<string,struct<old_value:string,new_value:string>>>")


def parse(document: Column) -> Column:
    """A JSON object text as a payload map; unreadable text gives null."""
    return F.transform_values(F.from_json(document, "map<string,variant>"),
                              lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def without(payload: Column, fields: list[str] | None = None) -> Column:
    """Drop storage-owned fields."""
    hidden = fields if fields is not None else fixed.STORAGE_FIELDS + fixed.RUN_STAMP_FIELDS
    return F.map_filter(payload, lambda k, v: ~k.isin(hidden))


def stamps(payload: Column, fields: list[str] | None = None) -> Column:
    """The storage-owned fields that ``without`` drops."""
    hidden = fields if fields is not None else fixed.STORAGE_FIELDS + fixed.RUN_STAMP_FIELDS
    return F.map_filter(payload, lambda k, v: k.isin(hidden))


def key_text(key: Column) -> Column:
    """A field name as JSON text; only names that need it are escaped."""
    return F.when(key.rlike(r'["\\\x00-\x1f]'), quoted(key)).otherwise(F.concat(F.lit('"'), key, F.lit('"')))


def canonical_text(payload: Column) -> Column:
    """The payload as one JSON object text with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(payload)),
                        lambda e: F.concat(key_text(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def content_hash(payload: Column, fields: list[str] | None = None) -> Column:
    """32 hex characters of the SHA-256 over the canonical text without storage fields."""
    return F.left(F.sha2(canonical_text(without(payload, fields)), 256), F.lit(32))


def diff(old: Column, new: Column, fields: list[str] | None = None) -> Column:
    """Added, removed and changed fields between two payloads."""
    def compare(b: Column) -> Column:
        before, after = b["before"], b["after"]
        paired = F.map_zip_with(before, after, lambda k, x, y: F.struct(
            x.alias("old_value"), y.alias("new_value"),
            (F.map_contains_key(before, k) & F.map_contains_key(after, k)).alias("both")))
        changed = F.transform_values(
            F.map_filter(paired, lambda k, v: v["both"] & ~v["old_value"].eqNullSafe(v["new_value"])),
            lambda k, v: F.struct(v["old_value"].alias("old_value"), v["new_value"].alias("new_value")))
        return F.struct(
            F.map_filter(after, lambda k, v: ~F.map_contains_key(before, k)).alias("added_fields"),
            F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k)).alias("removed_fields"),
            changed.alias("changed_fields"))

    return let(F.struct(without(old, fields).alias("before"), without(new, fields).alias("after")), compare)


def merge(old: Column, new: Column) -> Column:
    """New fields win, fields the new payload lacks stay."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.coalesce(F.map_concat(kept, new), new, old)


def stub(size: Column) -> Column:
    return F.create_map(F.lit("payload_truncated"), F.lit("true"),
                        F.lit("size_bytes"), size.cast("string"))


def cap(payload: Column, limit: int | None = None) -> Column:
    """Replace a payload above ``limit`` bytes by a stub that records its size; without a limit nothing is replaced."""
    if limit is None:
        return payload
    return let(F.octet_length(canonical_text(payload)),
               lambda size: F.when(size > limit, stub(size)).otherwise(payload))


def cap_value(value: Column, limit: int) -> Column:
    size = F.octet_length(value)
    return F.when(size > limit, F.concat(F.lit('{"payload_truncated":true,"size_bytes":'),
                                         size.cast("string"), F.lit("}"))).otherwise(value)


def cap_diff(changes: Column, limit: int | None = None) -> Column:
    """Replace single values of changed fields above ``limit`` bytes; the field name stays."""
    if limit is None:
        return changes
    return F.when(changes.isNotNull(), F.struct(
        changes["added_fields"].alias("added_fields"),
        changes["removed_fields"].alias("removed_fields"),
        F.transform_values(changes["changed_fields"], lambda k, v: F.struct(
            cap_value(v["old_value"], limit).alias("old_value"),
            cap_value(v["new_value"], limit).alias("new_value"))).alias("changed_fields")))


def shown(value: Column) -> Column:
    """A JSON value as the change log prints it: bare strings, None/True/False."""
    return (F.when(value.startswith('"'), F.coalesce(
                F.try_variant_get(F.try_parse_json(value), "$", "string"), value))
            .when(value == "null", F.lit("None"))
            .when(value == "true", F.lit("True"))
            .when(value == "false", F.lit("False"))
            .otherwise(value))


def fields_text(payload: Column) -> Column:
    """``field: value; …`` in field order; null gives ''."""
    parts = F.transform(F.array_sort(F.map_entries(payload)),
                        lambda e: F.concat(e["key"], F.lit(": "), shown(e["value"])))
    return F.coalesce(F.array_join(parts, "; "), F.lit(""))


def changes_text(changed: Column) -> Column:
    """``field: old → new; …`` in field order; null gives ''."""
    parts = F.transform(
        F.array_sort(F.map_keys(changed)),
        lambda k: F.concat(k, F.lit(": "), shown(changed[k]["old_value"]),
                           F.lit(" → "), shown(changed[k]["new_value"])))
    return F.coalesce(F.array_join(parts, "; "), F.lit(""))


def text_value(payload: Column, *fields: str) -> Column:
    """The first of the fields that holds a non-empty scalar, as plain text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(F.try_parse_json(
        F.try_element_at(payload, F.lit(f))), "$", "string"), F.lit("")) for f in fields])


def quoted(c: Column) -> Column:
    """A string column as JSON text; null becomes JSON null."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def of_columns(strings: dict[str, Column] | None = None, raw: dict[str, Column] | None = None) -> Column:
    """A payload map from typed columns: text columns are quoted, others printed as they are."""
    pairs: list[Column] = []
    for name, c in (strings or {}).items():
        pairs += [F.lit(name), quoted(c)]
    for name, c in (raw or {}).items():
        pairs += [F.lit(name), F.coalesce(c.cast("string"), F.lit("null"))]
    return F.create_map(*pairs)


def cap_envelope(data: Column, limit: int | None = None) -> Column:
    """A result document (JSON text) above ``limit`` bytes shrunk to its outline; without a limit all stay whole.

    The outline keeps the original size, the top-level keys, the number of
    products and the ``stats`` object.
    """
    if limit is None:
        return data
    size = F.octet_length(data)
    variant = F.try_parse_json(data)
    top = F.json_object_keys(data)
    outline = F.to_json(F.struct(
        F.lit(True).alias("truncated"),
        F.lit(fixed.TRUNCATED_REASON).alias("truncated_reason"),
        size.alias("original_size_bytes"),
        top.alias("original_keys"),
        F.size(F.try_variant_get(variant, "$.products", "array<variant>")).alias("products_count"),
        F.try_variant_get(variant, "$.stats", "variant").alias("stats")),
        {"ignoreNullFields": "false"})
    return F.when(size > limit, outline).otherwise(data)
