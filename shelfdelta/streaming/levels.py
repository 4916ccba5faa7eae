"""Levelled folds of micro-batches: a view reads a few files, however many batches there were.

Batch n writes its fold as block n of level 0. Whenever ``base`` blocks of a level are complete
they are merged into one block of the next, as in a log-structured merge tree, so N batches
stand in at most ``base - 1`` blocks a level. A batch that is repeated rewrites the same folders;
readers follow the last batch marked as done, so a batch that died half-way is not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfdelta.session import children, remove


def blocks(batches: int, base: int) -> list[tuple[int, int]]:
    """(level, block) that together hold the first ``batches`` batches, oldest first."""
    out, level = [], 0
    while batches:
        first = batches - batches % base
        out = [(level, b) for b in range(first, batches)] + out
        batches, level = batches // base, level + 1
    return out


class Levels:
    """``merge`` folds rows of several blocks, told apart by ``_slot``, into rows of ``schema``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], base: int = 8):
        self.spark, self.folder, self.schema, self.merge, self.base = spark, folder, schema, merge, base

    def _path(self, level: int, block: int) -> str:
        return f"{self.folder}/level={level}/block={block}"

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        out = None
        for level, block in parts:
            rows = self.spark.read.schema(self.schema).parquet(self._path(level, block)).withColumn(
                "_slot", F.lit(block * self.base**level).cast("bigint"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.schema + ", _slot bigint")

    def add(self, fold: DataFrame, batch: int) -> None:
        """Store a batch's fold and merge the levels that it completes."""
        fold.write.mode("overwrite").parquet(self._path(0, batch))
        level, done = 0, batch + 1
        while done % self.base == 0:
            done //= self.base
            full = [(level, b) for b in range((done - 1) * self.base, done * self.base)]
            level += 1
            self.merge(self._read(full)).write.mode("overwrite").parquet(self._path(level, done - 1))
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/done/{batch + 1}")

    def batches(self) -> int:
        """How many batches are complete; reads names alone."""
        return max([int(n) for n in children(self.spark, f"{self.folder}/done")], default=0)

    def current(self) -> list[tuple[int, int]]:
        return blocks(self.batches(), self.base)

    def read(self) -> DataFrame:
        """The rows of all complete batches, merged."""
        return self.merge(self._read(self.current()))

    def sweep(self, grace: int) -> int:
        """Remove blocks that no view since ``grace`` batches ago needs; returns how many. A reader that
        began within the grace is left alone."""
        last = self.batches()
        needed = {part for n in range(max(last - grace, 0), last + 1) for part in blocks(n, self.base)}
        # What the next merges will read stays, too: the open blocks of each level.
        old = [self._path(int(lv.removeprefix("level=")), int(b.removeprefix("block="))) for lv in children(self.spark, self.folder) if lv.startswith("level=")
               for b in children(self.spark, f"{self.folder}/{lv}")
               if (int(lv.removeprefix("level=")), int(b.removeprefix("block="))) not in needed
               and (int(b.removeprefix("block=")) + 1) * self.base ** int(lv.removeprefix("level=")) <= last]
        marks = [f"{self.folder}/done/{n}" for n in children(self.spark, f"{self.folder}/done") if int(n) < last - grace]
        remove(self.spark, old + marks)
        return len(old)
