"""Several tables written from each micro-batch that change together: a commit names the versions that count.

A batch writes each table's part under its own number and then one commit, a file that lists the parts of all tables. Readers follow the last commit, so what a batch
wrote before it failed is not seen, and is written over when the batch comes again. Batches before the last commit are ignored; numbers may be left
out. Tables are folded (a new state from the last one and the batch) or appended (a part for each batch, merged into one part now and then).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fluvia.sinks.publish import _path, withdraw


@dataclass
class Folded:
    """`fold(state or None, batch, batch_id)` gives the whole new state."""

    fold: Callable[[DataFrame | None, DataFrame, int], DataFrame]


@dataclass
class Appended:
    """`rows(batch, batch_id)` gives the batch's rows, `settle` (of all rows, to drop repetitions) what readers see and what merging keeps."""

    rows: Callable[[DataFrame, int], DataFrame]
    settle: Callable[[DataFrame], DataFrame] = lambda df: df


class BatchLog:
    """A foreachBatch sink over named tables; `merge_after` parts of an appended table become one."""

    def __init__(self, path: str, tables: dict[str, Folded | Appended], merge_after: int = 16):
        self.path, self.tables, self.merge_after = path.rstrip("/"), tables, merge_after

    def last(self, spark: SparkSession) -> dict | None:
        """The last commit: batch, and for each table its parts."""
        fs, p = _path(spark, f"{self.path}/commits")
        if not fs.exists(p):
            return None
        done = [s.getPath() for s in fs.listStatus(p) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        if not done:
            return None
        newest = max(done, key=lambda q: int(q.getName().removeprefix("b")))
        return json.loads(spark.read.text(newest.toString()).first()["value"])

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """What the last commit holds of a table."""
        at = self.last(spark)
        return None if at is None else self._read(spark, name, at["parts"][name])

    def _read(self, spark: SparkSession, name: str, parts: list[str]) -> DataFrame:
        df = spark.read.parquet(*[f"{self.path}/{name}/{p}" for p in parts])
        kind = self.tables[name]
        return kind.settle(df) if isinstance(kind, Appended) else df

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.last(spark)
        if before is not None and batch_id <= before["batch"]:
            return
        parts = {}
        for name, kind in self.tables.items():
            held = before["parts"][name] if before else []
            if isinstance(kind, Folded):
                out, held, part = kind.fold(self._read(spark, name, held) if held else None, batch, batch_id), [], f"b{batch_id}"
            else:
                out, part = kind.rows(batch, batch_id), f"b{batch_id}"
                if len(held) >= self.merge_after:
                    out, held, part = kind.settle(self._read(spark, name, held).unionByName(out)), [], f"merged{batch_id}"
            out.write.mode("overwrite").parquet(f"{self.path}/{name}/{part}")
            parts[name] = [*held, part]
        commit = spark.createDataFrame([(json.dumps({"batch": batch_id, "parts": parts}),)], "value string").coalesce(1)
        commit.write.mode("overwrite").text(f"{self.path}/commits/b{batch_id}")
        self._forget(spark, before, parts)

    def _forget(self, spark: SparkSession, before: dict | None, parts: dict) -> None:
        """Delete what only the commit before named, and older commits. A reader that holds that commit reads on until its next look."""
        if before is None:
            return
        for name, held in before["parts"].items():
            for p in set(held) - set(parts[name]):
                withdraw(spark, f"{self.path}/{name}/{p}")
        withdraw(spark, f"{self.path}/commits/b{before['batch']}")
