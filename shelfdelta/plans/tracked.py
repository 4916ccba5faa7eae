"""The tracked run: a batch of products into the catalog, with its audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfdelta.functions import payload as P
from shelfdelta.operators import diff as D, merge as M
from shelfdelta.session import cut_lineage
from shelfdelta.sources.buckets import bucket_of
from shelfdelta.sources.tables import Store, close_session, open_session


def moment(spark: SparkSession, at: Column) -> Column:
    """``at`` evaluated once: every row a run writes bears the same time."""
    one = spark.range(1).select(at.alias("at"))
    kind = one.schema["at"].dataType
    return F.lit(one.select(F.col("at").cast("string")).first()[0]).cast(kind)


def run(store: Store, source: str, documents: DataFrame, run_id: str, run_ts: Column,
        task_id: str | None = None, partial: bool = False, json: str = "doc",
        order: list[str] | None = None, hidden: list[str] | None = None) -> dict:
    """Classify, merge, tombstone and log one run; returns its counters.

    ``documents`` holds JSON product texts; ``order`` names columns that decide which
    copy of a key wins (the last; without ``order`` the last in the order of the rows). Texts
    that are no JSON object are counted as ``failed``. Keys and hashes decide what happens; payloads
    are fetched for changed keys alone and unchanged ones stay in the files they are in.
    """
    source, run_ts = source.strip().lower(), moment(store.spark, run_ts)
    open_session(store, run_id, source, run_ts, task_id, "partial" if partial else "full")
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    packed = documents.select(F.col(json).alias("doc"), place.alias("_order"))
    keyed = D.keyed(packed, source, "doc", hidden, keep=["_order"])
    return commit(store, source, keyed, run_id, run_ts, task_id, partial, hidden, D.unreadable(packed, "doc"), ["_order"])


def commit(store: Store, source: str, keyed: DataFrame, run_id: str, run_ts: Column,
           task_id: str | None = None, partial: bool = False, hidden: list[str] | None = None,
           rejected: DataFrame | None = None, order: list[str] | None = None) -> dict:
    """Apply keyed rows to the stored state and commit the result.

    Of copies of a key the last by ``order`` counts; without it ``keyed`` has one row per key.
    ``rejected`` rows are only counted. A run that fails closes its session as failed; a run
    whose base was replaced by another run meanwhile is refused and may be repeated.
    """
    try:
        return _commit(store, source, keyed, run_id, run_ts, task_id, partial, hidden, rejected, order)
    except Exception as error:
        close_session(store, run_id, source, run_ts, "failed", error=str(error).split("\n")[0])
        raise


def winners(keyed: DataFrame, hidden: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Key, hash and stamps of each key's last copy; payloads stay where they are."""
    rows = keyed.select("source", D.KEY, "data_hash", P.stamps(F.col("payload"), hidden).alias("stamps"), *(order or []))
    return D.latest_per_key(rows, D.KEY, order).drop(*order) if order else rows


def _commit(store: Store, source: str, keyed: DataFrame, run_id: str, run_ts: Column, task_id: str | None,
            partial: bool, hidden: list[str] | None, rejected: DataFrame | None, order: list[str] | None) -> dict:
    base = store.manifest(source)
    store.mark_snapshot(run_id, "pre_scrape", source, base.sequence, run_ts)
    last = cut_lineage(winners(keyed, hidden, order), f"keys-{run_id}")
    in_bucket = bucket_of(F.col(D.KEY), base.n_buckets)
    # A partial run looks at the buckets of its keys; a whole run at all, since it may delete anywhere.
    only = {r[0] for r in last.select(in_bucket).distinct().collect()} if partial else None
    decided = cut_lineage(M.decide(store.index([base], only), last, run_ts, base.sequence + 1, task_id, partial, hidden), f"decided-{run_id}")
    aged = decided.filter(F.col("change_type").isin("updated", "deleted"))
    old = {r[0] for r in aged.select(in_bucket).distinct().collect()}
    batch = keyed.select(D.KEY, "data_hash", P.without(F.col("payload"), hidden).alias("payload"))
    changed = cut_lineage(M.fetch(decided, batch, store.bodies([base], old), hidden), f"changed-{run_id}")
    store.replace_run("changes", M.records_of(changed, run_ts, task_id, run_id, hidden))
    bodies = changed.filter(F.col("change_type") != "deleted").select(D.KEY, "written", "payload")
    number = store.write_catalog(source, run_id, decided, run_ts, base.sequence, bodies)
    store.mark_snapshot(run_id, "post_scrape", source, number, run_ts)
    counters = M.run_counters(decided).first().asDict()
    failed = rejected.count() if rejected is not None else 0
    close_session(store, run_id, source, run_ts, "completed", counters["active_keys"],
                  counters["inserted"] + counters["stored_again"], failed)
    return {
        "storage": {"inserted": counters["inserted"], "updated": counters["stored_again"], "failed": failed},
        "changes": {k: counters[k] for k in ("added", "updated", "deleted", "unchanged", "soft_deleted")},
        "revived": counters["revived"], "is_partial": partial, "snapshot_id": run_id,
    }
