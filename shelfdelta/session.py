"""Session set-up and the few settings the jobs read back from it."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Nothing here fixes a partition count: AQE coalesces on small inputs and the
# cluster's own spark.sql.shuffle.partitions governs large ones.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "shelfdelta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_TEMPORARY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting (tests) gets a temporary folder; on a cluster a machine-local
    folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _TEMPORARY:
        _TEMPORARY[context.applicationId] = tempfile.mkdtemp(prefix="shelfdelta-")
    return _TEMPORARY[context.applicationId]


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for a table a job writes and reads back."""
    return f"{shared_dir(spark)}/shelfdelta/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where one result feeds several outputs: the plan behind it runs once and
    a lost executor costs a re-read, not a re-computation.
    """
    path = staging_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any file system Spark reads; none where it does not exist."""
    where, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders."""
    for path in paths:
        where, files = _at(spark, path)
        files.delete(where, True)


def sweep_staging(spark: SparkSession, hours: float) -> int:
    """Delete staged tables that nothing has touched for ``hours``; returns how many. Choose more than any job runs."""
    root, count = f"{shared_dir(spark)}/shelfdelta", 0
    where, files = _at(spark, root)
    limit = time.time() * 1000 - hours * 3_600_000
    for status in files.listStatus(where) if files.exists(where) else []:
        if status.getModificationTime() < limit:
            files.delete(status.getPath(), True)
            count += 1
    return count
