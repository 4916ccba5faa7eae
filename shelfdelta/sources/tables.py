"""Stored collections: append-only tables and the versioned catalog.

Parquet has no MERGE, so the catalog lies in buckets by key hash: per bucket one file set
of narrow index rows (key, hash, stamps) and the payloads, written once each. A run writes the
buckets it touches into a folder of its own and commits them with one appended row that lists
the files of every bucket, the untouched ones by reference. Readers follow commits; a run that
dies before its commit leaves the previous state untouched and may simply be run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from shelfdelta import schemas
from shelfdelta.functions import document, payload as P
from shelfdelta.session import children, remove
from shelfdelta.sources import buckets

COLLECTIONS = {
    "changes": schemas.CHANGES, "snapshots": schemas.SNAPSHOT, "results": schemas.RESULT,
    "errors": schemas.ERROR, "sessions": schemas.SESSION, "event_log": schemas.EVENT_LOG,
    "activity": schemas.ACTIVITY, "registry": schemas.REGISTRY, "tasks": schemas.TASK,
    "snapshot_marks": "run_id string, snapshot_type string, source string, sequence bigint, created_at timestamp_ntz",
}
# One folder per run, so that a repeated run can replace what it wrote before.
_PARTITIONED = {"changes": ["source", "session_id"], "snapshots": ["source", "run_id", "snapshot_type"],
                "snapshot_marks": ["source", "run_id", "snapshot_type"]}


def read_or_empty(spark: SparkSession, path: str, ddl: str, **options: str) -> DataFrame:
    """The Parquet folder, or no rows where it does not exist. Other errors are raised."""
    try:
        return spark.read.schema(ddl).options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_or_empty_paths(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


class Store:
    """A root folder with one sub-folder per collection.

    ``n_buckets`` counts for sources without a commit; choose it so that one bucket's payloads are
    a few hundred megabytes. A source keeps the number of its first commit.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 32):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A collection, empty when never written. Column lists reach the scan."""
        df = self.snapshots() if name == "snapshots" else read_or_empty(self.spark, self.path(name), COLLECTIONS[name])
        return df.select(*columns) if columns else df

    def _shaped(self, name: str, rows: DataFrame):
        shape = self.spark.createDataFrame([], COLLECTIONS[name]).schema
        have = set(rows.columns)
        typed = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                              for f in shape])
        return typed.write.partitionBy(*_PARTITIONED.get(name, []))

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows, missing fields as null, in the collection's column order."""
        self._shaped(name, rows).mode("append").parquet(self.path(name))

    def replace_run(self, name: str, rows: DataFrame) -> None:
        """Write a run's rows, replacing what an earlier attempt at the same run left.
        Other runs' folders are untouched."""
        self._shaped(name, rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    # -- catalog ---------------------------------------------------------------

    def commits(self) -> DataFrame:
        return read_or_empty(self.spark, self.path("commits"), buckets.COMMIT)

    def sequence(self, source: str) -> int:
        """The number of the source's last commit, 0 before the first."""
        last = self.commits().filter(F.col("source") == source).agg(F.max("sequence").alias("n")).first()
        return last["n"] or 0

    def manifest(self, source: str, sequence: int | None = None) -> buckets.Manifest:
        """The files of a source's last commit, or of the one numbered ``sequence``."""
        rows = self.commits().filter(F.col("source") == source)
        rows = rows.orderBy(F.desc("sequence")) if sequence is None else rows.filter(F.col("sequence") == sequence)
        last = rows.select("sequence", "n_buckets", "files").take(1)
        if not last:
            return buckets.Manifest(source, 0, self.n_buckets, {})
        return buckets.Manifest(source, last[0]["sequence"], last[0]["n_buckets"], {
            f["bucket"]: buckets.Files(f["index"], list(f["bodies"]), f["n_rows"], f["n_bodies"]) for f in last[0]["files"]})

    def manifests(self, source: str | None = None) -> list[buckets.Manifest]:
        """The current files of one source or of all (a driver value: one entry per bucket)."""
        names = [source] if source else [r["source"] for r in self.commits().select("source").distinct().collect()]
        return [self.manifest(name) for name in names]

    def index(self, manifests: list[buckets.Manifest], only: set[int] | None = None) -> DataFrame:
        """Keys, hashes and stamps, without payloads; with ``only``, of these buckets."""
        return read_or_empty_paths(self.spark, [p for m in manifests for p in m.index_paths(only)], schemas.INDEX)

    def bodies(self, manifests: list[buckets.Manifest], only: set[int] | None = None) -> DataFrame:
        """Written payloads, replaced ones included: (key, written) of the index tells which count."""
        return read_or_empty_paths(self.spark, [p for m in manifests for p in m.body_paths(only)], schemas.BODY)

    def catalog(self, source: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The committed state of one source or of all; payloads are read only where asked for."""
        return self._joined(self.manifests(source), columns)

    def _joined(self, manifests: list[buckets.Manifest], columns: list[str] | None = None, only: set[int] | None = None,
                keys: list[str] | None = None) -> DataFrame:
        index, bodies = self.index(manifests, only), self.bodies(manifests, only)
        if keys is not None:
            index, bodies = (df.filter(F.col("product_key").isin(keys)) for df in (index, bodies))
        names = columns or [f.name for f in StructType.fromDDL(schemas.CATALOG)]
        if "payload" not in names:
            return index.select(*names)
        rows = index.join(bodies, ["product_key", "written"], "left")
        return rows.withColumn("payload", P.merge(F.col("payload"), F.col("stamps"))).select(*names)

    def lookup(self, keys: list[str], source: str, columns: list[str] | None = None) -> DataFrame:
        """The stored rows of a few keys, out of the files of their buckets alone."""
        manifest = self.manifest(source)
        asked = self.spark.createDataFrame([(k,) for k in keys], "product_key string")
        only = {r[0] for r in asked.select(buckets.bucket_of(F.col("product_key"), manifest.n_buckets)).distinct().collect()}
        return self._joined([manifest], columns, only, list(keys))

    def products(self, source: str | None = None) -> DataFrame:
        """The committed state as typed product documents."""
        return document.products(self.catalog(source))

    def write_catalog(self, source: str, run_id: str, state: DataFrame, committed_at: Column, base: int | None = None,
                      bodies: DataFrame | None = None) -> int:
        """Write and commit a source's state; returns the commit's number.

        ``state`` has whole buckets: index rows, with the payloads that are new in ``bodies``; or rows with a
        payload each and without ``bodies``, which are written anew. Buckets that ``state`` has no row of stay as
        they were. ``base`` is the commit the state was derived from; another commit since then refuses this one.
        """
        old = self.manifest(source) if base is None else self.manifest(source, base)
        number = old.sequence + 1
        path = f"{self.path('catalog')}/source={source}/commit={number}-{run_id}"
        if bodies is None:
            state = state.withColumn("written", F.lit(number).cast("bigint"))
            bodies = state.select("product_key", "written", "payload")
        bucket = buckets.bucket_of(F.col("product_key"), old.n_buckets)
        buckets.write(state, schemas.INDEX, bucket, f"{path}/index")
        buckets.write(bodies, schemas.BODY, bucket, f"{path}/bodies")
        sizes = buckets.sizes(self.spark, path, bucket)
        self._commit(old, run_id, committed_at, old.replaced(path, sizes))
        return number

    def _commit(self, old: buckets.Manifest, run_id: str, committed_at: Column, files: dict[int, buckets.Files]) -> None:
        if self.sequence(old.source) != old.sequence:
            raise RuntimeError(f"{old.source}: another run has committed since this one began; repeat it")
        entries = [(b, f.index, f.bodies, f.n_rows, f.n_bodies) for b, f in sorted(files.items())]
        row = self.spark.createDataFrame([(old.source, run_id, old.sequence + 1, old.n_buckets, entries)],
                                         "source string, run_id string, sequence bigint, n_buckets int, files " + buckets.FILES)
        row.withColumn("committed_at", committed_at.cast("timestamp_ntz")).write.mode("append").parquet(self.path("commits"))

    def compact(self, source: str, committed_at: Column, most_files: int = 8, most_stale: float = 1.0) -> int:
        """Rewrite the payloads of buckets that lie in more than ``most_files`` folders or hold more than
        ``most_stale`` replaced payloads a row; returns how many. Index files and other buckets stay."""
        old = self.manifest(source)
        due = {b for b, f in old.files.items() if len(f.bodies) > most_files or f.n_bodies - f.n_rows > most_stale * f.n_rows}
        if due:
            path = f"{self.path('catalog')}/source={source}/commit={old.sequence + 1}-compacted"
            live = self.bodies([old], due).join(self.index([old], due).select("product_key", "written"), ["product_key", "written"], "left_semi")
            buckets.write(live, schemas.BODY, buckets.bucket_of(F.col("product_key"), old.n_buckets), f"{path}/bodies")
            files = {b: buckets.Files(f.index, [f"{path}/bodies/bucket={b}"], f.n_rows, f.n_rows) if b in due else f for b, f in old.files.items()}
            self._commit(old, "compacted", committed_at, files)
        return len(due)

    def oldest(self, source: str) -> int:
        """The first commit that no sweep has given up."""
        swept = read_or_empty(self.spark, self.path("swept"), "source string, oldest bigint").filter(F.col("source") == source)
        return swept.agg(F.coalesce(F.max("oldest"), F.lit(0)).alias("n")).first()["n"]

    def sweep(self, source: str, keep: int = 5) -> int:
        """Delete the files that none of the last ``keep`` commits refers to, and what runs without a commit left;
        returns how many folders. Readers of a kept commit are left alone, older commits can be read no more."""
        last = self.sequence(source)
        first = max(last - keep + 1, 1)
        live = {p for n in range(first, last + 1) for m in [self.manifest(source, n)] for p in m.index_paths() + m.body_paths()}
        self.spark.createDataFrame([(source, first)], "source string, oldest bigint").write.mode("append").parquet(self.path("swept"))
        root, gone = f"{self.path('catalog')}/source={source}", []
        for commit in children(self.spark, root):
            # A run in progress writes the number after the last one.
            if commit.startswith("commit=") and int(commit[7:].split("-")[0]) <= last:
                found = {f"{root}/{commit}/{kind}/{b}" for kind in ("index", "bodies") for b in children(self.spark, f"{root}/{commit}/{kind}") if "=" in b}
                gone += [f"{root}/{commit}"] if not found & live else sorted(found - live)
        remove(self.spark, gone)
        return len(gone)

    # -- snapshots -------------------------------------------------------------

    def mark_snapshot(self, run_id: str, kind: str, source: str, sequence: int, at: Column) -> None:
        """A run's snapshot by reference: the keys of a commit, or those that the commit itself saw."""
        self._shaped("snapshot_marks", self.spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(kind).alias("snapshot_type"), F.lit(source).alias("source"),
            F.lit(sequence).alias("sequence"), at.alias("created_at"))).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(self.path("snapshot_marks"))

    def snapshots(self, run_id: str | None = None, kind: str | None = None) -> DataFrame:
        """Keys and hashes before and after runs, out of the index files of their commits."""
        rows = read_or_empty(self.spark, self.path("snapshots"), schemas.SNAPSHOT)
        marks = read_or_empty(self.spark, self.path("snapshot_marks"), COLLECTIONS["snapshot_marks"])
        for name, value in (("run_id", run_id), ("snapshot_type", kind)):
            rows, marks = (df.filter(F.col(name) == value) if value else df for df in (rows, marks))
        oldest = {s: self.oldest(s) for s in {m["source"] for m in marks.select("source").distinct().collect()}}
        for m in marks.collect():
            if m["sequence"] and m["sequence"] < oldest[m["source"]]:
                continue  # given up by a sweep
            keys = self.index([self.manifest(m["source"], m["sequence"])])
            if m["snapshot_type"] == "post_scrape":
                keys = keys.filter(F.col("seen_in") == m["sequence"])
            rows = rows.unionByName(snapshot_rows(keys, m["run_id"], m["snapshot_type"], F.lit(m["created_at"])))
        return rows


def open_session(store: Store, session_id: str, source: str, at: Column, task_id: str | None = None,
                 scrape_type: str = "full") -> None:
    store.append("sessions", store.spark.range(1).select(
        F.lit(session_id).alias("session_id"), F.lit(source).alias("source"),
        F.lit(task_id).alias("task_id"), F.lit(scrape_type).alias("scrape_type"),
        F.lit("started").alias("status"), at.alias("started_at"), F.lit(0).alias("products_found"),
        F.lit(0).alias("products_stored"), F.lit(0).alias("products_failed"), at.alias("recorded_at")))


def close_session(store: Store, session_id: str, source: str, at: Column, status: str, found: int = 0,
                  stored: int = 0, failed: int = 0, error: str | None = None) -> None:
    store.append("sessions", store.spark.range(1).select(
        F.lit(session_id).alias("session_id"), F.lit(source).alias("source"), F.lit(status).alias("status"),
        at.alias("completed_at"), F.lit(found).alias("products_found"), F.lit(stored).alias("products_stored"),
        F.lit(failed).alias("products_failed"), F.lit(error).alias("error"), at.alias("recorded_at")))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session: the last row's status and counters, the opening row's
    task, type and start."""
    last = lambda c: F.max_by(c, F.struct("recorded_at", F.col("completed_at").isNotNull())).alias(c)
    return sessions.groupBy("session_id").agg(
        last("source"), F.max("task_id").alias("task_id"), F.max("scrape_type").alias("scrape_type"),
        last("status"), F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"),
        last("products_found"), last("products_stored"), last("products_failed"), last("error"))


def recent_sessions(sessions: DataFrame, source: str | None = None, limit: int = 10) -> DataFrame:
    latest = latest_sessions(sessions)
    chosen = latest.filter(F.col("source") == source) if source else latest
    return chosen.orderBy(F.col("started_at").desc(), "session_id").limit(limit)


def snapshot_rows(state: DataFrame, run_id: str, kind: str, at: Column) -> DataFrame:
    """Key and hash of every stored row, as rows rather than one big map."""
    return state.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("snapshot_type"), "source",
                        "product_key", "data_hash", at.alias("created_at"))
