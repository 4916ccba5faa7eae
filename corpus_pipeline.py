"""Corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared
folder and gives the re-read table to the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfdelta.llm import binary_packing, ecoc_langid, jaccard_join, quality_table, window_doubling
from shelfdelta.llm.common import staged, text_or_empty


def _own(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the new name of each column."""
    names = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


#: A text of two languages is no bad text: only one whose two best languages are nearly even goes.
LEAST_LEAD = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is told; goes by the text alone."""
    model = ecoc_langid.train(docs)
    own, names = _own(docs)
    judged = ecoc_langid.predict(own, model, text=names["text"], least_lead=LEAST_LEAD)
    return _back(judged.where("lang_pred <> 'und' and not lang_ambiguous"), names)


#: One or two repeated lines of a short text tell nothing: from so many on their share counts.
LEAST_DUP_LINES = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the table of quality rules."""
    return quality_table.kept(docs, least_dup_lines=LEAST_DUP_LINES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates; rows without id stay.

    Of rows that repeat an id one stays: that of the least text digest, as the join judges it, then the
    least in JSON form.
    """
    classes = jaccard_join.near_duplicates(docs)
    stay = classes.where("doc_id = class_id").select(F.col("doc_id").alias("stay"))
    own, names = _own(docs)
    key = F.col(names["doc_id"])
    kept = own.join(stay, key == F.col("stay"), "left_semi")
    repeated = own.groupBy(key.alias("repeated")).count().where("count > 1 and repeated is not null").select("repeated")
    once = kept.join(repeated, key == F.col("repeated"), "left_anti")
    row = F.struct(*own.columns)
    first = kept.join(repeated, key == F.col("repeated"), "left_semi").groupBy(key).agg(
        F.min_by(row, F.struct(F.sha2(text_or_empty(names["text"]), 256), F.to_json(row))).alias("row")).select("row.*")
    return _back(once.unionByName(first).unionByName(own.where(key.isNull())), names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words and more that an earlier document has; a text left without words goes."""
    cut = window_doubling.deduplicated(docs).where("doc_id is not null and n_removed > 0").dropDuplicates(["doc_id", "source_sha256"])
    own, names = _own(docs)
    body = F.col(names["text"])
    joined = own.join(cut, (F.col(names["doc_id"]) == F.col("doc_id")) & (F.sha2(text_or_empty(names["text"]), 256) == F.col("source_sha256")), "left")
    changed = F.col("n_removed").isNotNull()
    out = joined.where("n_removed is null or n_removed < n_words").withColumn(names["text"], F.when(changed, F.col("kept_text")).otherwise(body))
    if "n_chars" in names:
        count = names["n_chars"]
        out = out.withColumn(count, F.when(changed, F.length(body).cast(own.schema[count].dataType)).otherwise(F.col(count)))
    return _back(out, names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two length."""
    import public_tokenizers as known

    return binary_packing.pack(docs, known.path("byte_bpe_50k.json"), known.PATTERN)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("packing", packing)]

#: No SQL: language identification and tokenizing have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
