"""Alerts on a rise to a level: one per key and quiet time, counted from the alert that was sent; the same rows from a table and from a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

HOUR_MS = 3_600_000


def _spaced(quiet_ms: int):
    """Of rows in the order of (key, at), those at least `quiet_ms` after the last one kept of their key. Carries one row from batch to batch."""

    def run(batches):
        key = sent = None
        for b in batches:
            keep = []
            for i, (k, at) in enumerate(zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True)):
                if k != key or at - sent >= quiet_ms:
                    key, sent = k, at
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def alerts(levels: DataFrame, high: float, quiet_hours: float = 20) -> DataFrame:
    """Rows (key, at in milliseconds, id, level) of `levels` with which an alert goes out: the level rose to `high` from below, and no alert went out
    less than the quiet time ago. The first row of a key is silent, as there is nothing to compare with; a null level is unknown, and a rise
    from it is none.

    Rises are found by a window; only they are passed through in order, one key after another, with one row of memory.
    """
    w = Window.partitionBy("key").orderBy("at", "id")
    rises = levels.select("key", "at", "id", "level").withColumn("_before", F.lag("level").over(w)).filter(F.col("level").isNotNull() & (F.col("level") >= high) & (F.col("_before") < high)).drop("_before")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rises.schema)
    return rises.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(_spaced(int(quiet_hours * HOUR_MS)), kind)


def alert_stream(levels: DataFrame, high: float, quiet_hours: float = 20) -> DataFrame:
    """`alerts` of a stream whose rows come in order of `at` but for those within a micro-batch. State per key: the last level, its time, and the last
    alert's; a row before the last time is refused."""
    quiet = int(quiet_hours * HOUR_MS)
    kinds = {c: dict(levels.dtypes)[c] for c in ("key", "at", "id", "level")}

    def each(key, chunks, state):
        last, seen, sent = state.get if state.exists else (None, None, None)
        rows = pd.concat([c[["at", "id", "level"]] for c in chunks]).sort_values(["at", "id"])
        out = []
        for at, i, level in rows.itertuples(index=False):
            if seen is not None and at < seen:
                continue
            level = None if pd.isna(level) else float(level)
            if seen is not None and level is not None and last is not None and last < high <= level and (sent is None or at - sent >= quiet):
                sent = int(at)
                out.append((key[0], at, i, level))
            last, seen = level, int(at)
        state.update((last, seen, sent))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "id", "level"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return levels.groupBy("key").applyInPandasWithState(each, schema, "last double, seen long, sent long", "append", GroupStateTimeout.NoTimeout)


class Outbox:
    """A queue of alerts between a stream and a sender, by foreachBatch. A batch that is replayed takes its own place again; what was
    sent is logged by (key, at), so draining again after a failure sends only what is not logged."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/queue/batch={batch_id}")
        self._schema = batch.schema

    def pending(self, spark, schema: str, after: int | None = None) -> DataFrame:
        """Alerts that wait, `after` a time in milliseconds if given: older ones have expired."""
        queue = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/queue")
        queue = queue.dropDuplicates(["key", "at"]) if after is None else queue.filter(F.col("at") >= after).dropDuplicates(["key", "at"])
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/sent")  # so that there is a log to read
        sent = spark.read.schema(schema).parquet(f"{self.path}/sent")
        return queue.join(sent.select("key", "at"), ["key", "at"], "left_anti")

    def drain(self, spark, schema: str, send: Callable[[dict], bool], after: int | None = None) -> int:
        """Send what waits, and log what `send` took. It runs on the executors, a row at a time, as the receiver asks."""
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for b in batches:
                rows = b.to_pylist()
                yield b.take(pa.array([i for i, r in enumerate(rows) if send(r)], pa.int64()))

        done = self.pending(spark, schema, after).select(*names).mapInArrow(run, schema)
        path = f"{self.path}/run-{uuid.uuid4().hex[:8]}"
        done.write.parquet(path)  # sent once; then logged
        log = spark.read.schema(schema).parquet(path)
        log.write.mode("append").parquet(f"{self.path}/sent")
        return log.count()
