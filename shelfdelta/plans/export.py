"""Export jobs: fixed sheet, dynamic tiers, results, change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from shelfdelta.functions import document, fixed, predicates as W
from shelfdelta.operators import diff as D, quality as Q, sheet as S, variants as V
from shelfdelta.sources import csv_files, envelope

DYNAMIC_SOURCE = "customnapkinsnow"


def selected(products: DataFrame, source: str | None = None, start=None, end=None) -> DataFrame:
    """Alive products of a source and date range; the predicate reaches the scan."""
    return products.filter(W.products_filter(source, start, end))


def newest_first(rows: DataFrame) -> DataFrame:
    """A range sort by creation time, file by file; rows without one keep their order."""
    return rows.orderBy(F.col("created_at").desc()) if "created_at" in rows.columns else rows


def fixed_sheet(products: DataFrame, source: str | None = None, start=None, end=None,
                expanded: bool = True, house_label: str = "Catalog SKU",
                keep: list[str] | None = None) -> DataFrame:
    rows = selected(products, source, start, end)
    return S.to_sheet(rows, expanded, [source] if source else None, house_label, keep)


def dynamic_sheet(products: DataFrame, source: str = DYNAMIC_SOURCE, start=None, end=None,
                  keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Rows and size of the dynamic-tier export.

    Two passes: one aggregate over four pruned columns fixes the number of tier
    columns (a single driver value), then rows are expanded in place.
    """
    rows = selected(products, source, start, end)
    size = V.export_size(rows).first().asDict()
    return V.expand_variants(rows, size["max_tiers"], keep).drop("variant_ordinal"), size


def products_csv(products: DataFrame, path: str, source: str | None = None, start=None, end=None,
                 expanded: bool = True, rows_per_file: int = 0, house_label: str = "Catalog SKU",
                 order: list[Column] | None = None) -> dict:
    """Write an export, newest products first; the dynamic source takes its own shape. Returns its size."""
    name = (source or "").strip().lower()
    chosen = selected(products, source, start, end)
    ordered = chosen.orderBy(*order) if order else newest_first(chosen)
    if name == DYNAMIC_SOURCE:
        size = V.export_size(chosen).first().asDict()
        rows = V.expand_variants(ordered, size["max_tiers"]).drop("variant_ordinal")
    else:
        rows = S.to_sheet(ordered, expanded, [name] if name else None, house_label)
        size = {"max_tiers": 0}
    csv_files.write(rows, path, rows_per_file)
    return size


def blueprint_csv(products: DataFrame, path: str, blueprint_id: int | None = None,
                  provider_id: int | None = None, source: str = "printify",
                  include_deleted: bool = False, house_label: str = "Catalog SKU") -> None:
    """One API catalog's sheet, sorted by blueprint; a range sort, file by file."""
    chosen = products.filter(W.every(
        W.same_source(source), W.matching(blueprint_id=blueprint_id, provider_id=provider_id),
        None if include_deleted else W.alive()))
    csv_files.write(S.to_sheet(chosen.orderBy("blueprint_id", "product_id"), False, [source], house_label), path)


def result_rows(results: DataFrame, source: str | None = None, start=None, end=None,
                expanded: bool = True, house_label: str = "Catalog SKU") -> DataFrame:
    """Sheet rows of stored result envelopes."""
    chosen = results.filter(W.results_filter(source, start, end))
    docs = envelope.explode_products(chosen, envelope.export_products(F.col("data")))
    parsed = docs.select(F.coalesce("site", F.lit("unknown")).alias("_site"),
                         document.product(F.col("doc")).alias("p")).select("_site", "p.*")
    return S.to_sheet(parsed.withColumn("source", F.col("_site")).drop("_site"), expanded,
                      [source] if source else None, house_label)


def changes_csv(changes: DataFrame, path: str, source: str | None = None, change_type: str | None = None,
                start=None, end=None, rows_per_file: int = 0) -> None:
    chosen = changes.filter(W.changes_filter(source, None, change_type, start, end))
    csv_files.write(D.change_log(newest_first(chosen)), path, rows_per_file)


def column_list(products: DataFrame, source: str | None = None,
                house_label: str = "Catalog SKU") -> list[str]:
    """The headers an export of the source would have."""
    if (source or "").strip().lower() != DYNAMIC_SOURCE:
        return fixed.sheet_columns(house_label)
    return fixed.dynamic_columns(V.export_size(selected(products, source)).first()["max_tiers"])


def checked_sheet(documents: DataFrame, source: str, json: str = "doc", keep: list[str] | None = None, house_label: str = "Catalog SKU") -> DataFrame:
    """JSON product texts as sheet rows, with ``problems`` and ``outcome`` (``good`` or ``bad``) behind them."""
    # Carried columns get names that no document field has.
    own = {f"_kept_{k}": k for k in keep or []}
    rows = documents.select(*[F.col(k).alias(n) for n, k in own.items()], Q.document_problems(F.col(json)).alias("problems"),
                            document.product(F.col(json)).alias("p"))
    typed = rows.select(*own, "problems", "p.*").withColumn("source", F.lit(source))
    sheet = S.to_sheet(typed, False, [source], house_label, [*own, "problems"]).withColumnsRenamed(own)
    return sheet.withColumn("outcome", F.when(F.size("problems") > 0, "bad").otherwise("good"))


def write_by_outcome(rows: DataFrame, path: str) -> dict:
    """All rows in one write, ``outcome=good`` and ``outcome=bad`` apart; returns how many went where.

    The counts are observed while the rows are written: no second job.
    """
    seen = Observation()
    bad = F.col("outcome") == "bad"
    rows.observe(seen, F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems")).write.mode(
        "overwrite").partitionBy("outcome").parquet(path)
    return {**seen.get, "good": seen.get["rows"] - seen.get["bad"]}


def error_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per problem of the bad rows that ``write_by_outcome`` wrote."""
    return rows.filter(F.col("outcome") == "bad").select(*keep, F.inline("problems"))
