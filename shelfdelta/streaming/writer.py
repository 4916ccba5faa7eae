"""The tracked writer fed by a stream.

Micro-batches only stage keyed rows, each into a folder named after its batch id,
so a replayed batch replaces itself. When the stream has drained, one batch job
resolves copies (the last wins), merges, tombstones and logs. Staging is
append-only and needs no join, however long the run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfdelta.operators import diff as D
from shelfdelta.plans import tracked
from shelfdelta.session import staging_path
from shelfdelta.sources.tables import Store, open_session, read_or_empty

_STAGED = "source string, product_key string, payload map<string,string>, data_hash string, batch_id bigint, place bigint"


class TrackedStream:
    """Drive with ``start`` or ``drain``, then ``finalize`` once."""

    def __init__(self, store: Store, source: str, run_id: str, run_ts: Column, task_id: str | None = None,
                 partial: bool = False, hidden: list[str] | None = None, folder: str | None = None):
        self.store, self.source, self.run_id = store, source.strip().lower(), run_id
        self.run_ts = tracked.moment(store.spark, run_ts)
        self.task_id, self.partial, self.hidden = task_id, partial, hidden
        self.folder = folder or staging_path(store.spark, f"stream-{run_id}")
        self._done = False
        open_session(store, run_id, self.source, self.run_ts, task_id, "partial" if partial else "full")

    def process_batch(self, documents: DataFrame, batch_id: int, json: str = "doc") -> None:
        """Stage one micro-batch; also usable directly with batches at hand."""
        if self._done:
            raise RuntimeError("process_batch after finalize")
        rows = D.keyed(documents.select(F.col(json).alias("doc")), self.source, "doc", self.hidden)
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn(
            "place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(
            f"{self.folder}/rows/batch={batch_id}")

    def drain(self, stream: DataFrame, json: str = "doc") -> None:
        """Read everything the stream has now, then stop."""
        query = (stream.writeStream.foreachBatch(lambda df, n: self.process_batch(df, n, json))
                 .option("checkpointLocation", f"{self.folder}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def finalize(self) -> dict:
        """Merge, sweep (unless partial) and log; returns the run's counters.

        A run without batches is an empty run. A finalize that fails may be repeated.
        """
        if self._done:
            raise RuntimeError("finalize called twice")
        staged = read_or_empty(self.store.spark, f"{self.folder}/rows", _STAGED, recursiveFileLookup="true")
        counters = tracked.commit(self.store, self.source, staged, self.run_id, self.run_ts, self.task_id,
                                  self.partial, self.hidden, order=["batch_id", "place"])
        self._done = True
        return counters
