"""Content-addressed WARC archive.

``ingest`` turns pages into WARC/1.1 records and stores them as two tables: ``payloads``
has each distinct payload once, under its SHA-256; ``records`` has the exact header bytes of
each record and the SHA-256 of its payload. ``restore`` joins both and verifies each payload
against its digest, so the original record is ``header || payload || CRLF CRLF``.

Both tables are bucketed and sorted by digest, so payloads are shuffled once, copies collapsed
before that, and the join moves nothing. Payloads of more than ``_hot_from`` records (10,000 digests at
most) have a pair of tables of their own without buckets, whose join AQE can split.

Defined results: a null payload is empty; a null url gives an empty WARC-Target-URI; of equal
payloads of at least ``least_bytes`` the record with the largest id is the response and the
others revisit it, so repeated rows of that id are all responses; smaller payloads are all
responses; a null id sorts below every id. An empty table gives empty tables. Other columns
are left out. A payload that does not match its digest fails the read (``verify``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfdelta.session import cut_lineage

_CRLF = "\r\n"
_HEX32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_of_hex(digest: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal text whose length is a multiple of five."""
    groups = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, digits + 1, 5)]
    return F.translate(F.concat(*groups), *_HEX32)


def record_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def ingest(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
           least_bytes: int = 0) -> None:
    """Archive ``pages`` below ``path``: tables ``records`` and ``payloads``."""
    body = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), body.alias("payload")).select(
        "record_id", "url", "payload", F.sha2("payload", 256).alias("sha256"))
    heads = rows.select("record_id", "url", "sha256", F.length("payload").cast("long").alias("payload_bytes"),
                        base32_of_hex(F.sha1("payload")).alias("sha1"))
    # max() skips nulls: a group without any id has a null original and only responses.
    originals = heads.groupBy("sha256").agg(F.max("record_id").alias("original"), F.count("*").alias("n"))
    hot = cut_lineage(originals.where(F.col("n") > _hot_from(pages.count())), "warc-hot")
    n_hot, n_buckets = hot.count(), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("record_id"))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(_CRLF + "WARC-Record-ID: "), record_urn(F.col("record_id")),
        F.lit(_CRLF + "WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.when(revisit, F.concat(F.lit(_CRLF + "WARC-Refers-To: "), record_urn(F.col("original")))).otherwise(F.lit("")),
        F.lit(_CRLF + "WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(_CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF + _CRLF))

    def records(of: DataFrame, known: DataFrame) -> DataFrame:
        return of.join(known, "sha256").select("record_id", F.encode(header, "UTF-8").alias("header"), "sha256")

    def payloads(of: DataFrame) -> DataFrame:
        return of.groupBy("sha256").agg(F.first("payload").alias("payload"))

    few = F.broadcast(hot.select("sha256"))
    cold = (lambda df: df.join(few, "sha256", "left_anti")) if n_hot else (lambda df: df)
    for name, df in (("records", records(cold(heads), originals)), ("payloads", payloads(cold(rows)))):
        # As many buckets as shuffle partitions: each task has its buckets to itself.
        df.write.bucketBy(n_buckets, "sha256").sortBy("sha256").option("path", f"{path}/{name}").saveAsTable(_table(path, name))
    if n_hot:
        records(heads, F.broadcast(hot)).write.parquet(f"{path}/hot-records")
        payloads(rows.join(few, "sha256", "left_semi")).write.parquet(f"{path}/hot-payloads")
    pages.sparkSession.createDataFrame([(n_buckets, n_hot, rows.schema["record_id"].dataType.simpleString())], "n_buckets int, n_hot long, id_type string").write.parquet(f"{path}/layout")


def _hot_from(rows: int) -> int:
    """Records of one payload from which it counts as hot; no more than 10,000 digests can have as many."""
    return max(1_000, rows // 10_000)


def _table(path: str, name: str) -> str:
    return f"warc_{hashlib.sha1(path.encode()).hexdigest()[:16]}_{name}"


def _bucketed(spark: SparkSession, path: str, name: str, columns: str, n_buckets: int) -> DataFrame:
    """An archive's folder as a table that knows its buckets."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(path, name)} ({columns}) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) "
              f"INTO {n_buckets} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(_table(path, name))


def verify(payload: Column, sha256: Column) -> Column:
    """``payload``, or a failed job where its digest differs."""
    return F.when(F.sha2(payload, 256) == sha256, payload).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or damaged: "), sha256)).cast("binary"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Every archived record: record_id, header, payload (both exact bytes)."""
    layout = spark.read.parquet(f"{path}/layout").first()

    def joined(records: DataFrame, payloads: DataFrame) -> DataFrame:
        checked = payloads.select("sha256", verify(F.col("payload"), F.col("sha256")).alias("payload"))
        return records.join(checked, "sha256", "left").select(
            "record_id", "header", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(
                F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("sha256"))).cast("binary")).alias("payload"))

    out = joined(_bucketed(spark, path, "records", f"record_id {layout['id_type']}, header binary, sha256 string", layout["n_buckets"]),
                 _bucketed(spark, path, "payloads", "sha256 string, payload binary", layout["n_buckets"]))
    if layout["n_hot"]:
        out = out.unionByName(joined(spark.read.parquet(f"{path}/hot-records"), spark.read.parquet(f"{path}/hot-payloads")))
    return out


def record_bytes() -> Column:
    """The whole record as it stands in a WARC file."""
    return F.concat("header", "payload", F.encode(F.lit(_CRLF * 2), "UTF-8"))


def header_field(name: str) -> Column:
    """A header's value, null where the record has no such header."""
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.decode("header", "UTF-8").contains(f"\r\n{name}: "), value)
