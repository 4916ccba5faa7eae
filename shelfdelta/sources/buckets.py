"""Files of a catalog source in buckets by key hash, and the manifest that lists them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FILES = "array<struct<bucket:int,index:string,bodies:array<string>,n_rows:bigint,n_bodies:bigint>>"
COMMIT = f"source string, run_id string, sequence bigint, n_buckets int, committed_at timestamp_ntz, files {FILES}"


@dataclass(frozen=True)
class Files:
    """One bucket: its index folder, its payload folders, rows and payloads in them."""

    index: str
    bodies: list[str]
    n_rows: int
    n_bodies: int


@dataclass(frozen=True)
class Manifest:
    """What a commit consists of; bounded by the number of buckets."""

    source: str
    sequence: int
    n_buckets: int
    files: dict[int, Files]

    def index_paths(self, only: set[int] | None = None) -> list[str]:
        return [f.index for b, f in self.files.items() if only is None or b in only]

    def body_paths(self, only: set[int] | None = None) -> list[str]:
        return [p for b, f in self.files.items() if only is None or b in only for p in f.bodies]

    def replaced(self, path: str, sizes: dict[int, tuple[int, int]]) -> dict[int, Files]:
        """The files after a run that wrote (rows, payloads) of some buckets below ``path``."""
        out = dict(self.files)
        for b, (rows, fresh) in sizes.items():
            had = out.get(b, Files("", [], 0, 0))
            out[b] = Files(f"{path}/index/bucket={b}", had.bodies + [f"{path}/bodies/bucket={b}"] * (fresh > 0), rows, had.n_bodies + fresh)
        return out


def bucket_of(key: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def write(rows: DataFrame, ddl: str, bucket: Column, path: str) -> None:
    """One folder per bucket, rows in key order, a bloom filter on the key.

    Rows meet by bucket; AQE cuts a large bucket into several files and joins small ones in a task.
    """
    shape = StructType.fromDDL(ddl)
    have = set(rows.columns)
    typed = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    typed.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "product_key").write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#product_key", "true").partitionBy("bucket").parquet(path)


def sizes(spark: SparkSession, path: str, bucket: Column) -> dict[int, tuple[int, int]]:
    """(rows, payloads) per bucket written below ``path``: two counts over the key column alone."""
    def counted(name: str) -> dict[int, int]:
        rows = spark.read.schema("product_key string").option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
        return {r[0]: r[1] for r in rows.groupBy(bucket.alias("b")).count().collect()}

    fresh = counted("bodies")
    return {b: (n, fresh.get(b, 0)) for b, n in counted("index").items()}
