"""Tables that appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _path(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def withdraw(spark, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, path: str, expected: int, kind: str = "csv", **options) -> int | None:
    """Write `df` beside `path`, count what a reader finds there, and move it to `path` only if that is `expected`.

    Otherwise an older copy at `path` is withdrawn too, so that what is published never disagrees with what was counted; the result is None.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    df.write.format(kind).options(**options).save(beside)
    n = spark.read.format(kind).schema(df.schema).options(**options).load(beside).count()
    withdraw(spark, path)
    fs, p = _path(spark, beside)
    if n != expected:
        fs.delete(p, True)
        return None
    if not fs.rename(p, _path(spark, path)[1]):
        raise OSError(f"{beside} can't be moved to {path}")
    return n


def health(**checks: DataFrame) -> dict[str, dict[str, object]]:
    """For each named table its number of rows, and whether it has any."""
    counts = {name: df.count() for name, df in checks.items()}
    return {name: {"rows": n, "ok": n > 0} for name, n in counts.items()}
