"""A Python data source over a paged feature layer: one partition per range of offsets, retries with back-off, comparisons pushed to the layer
as conditions (with the option push, where spark.sql.python.filterPushdown.enabled is on), and an order that keeps pages apart.

The layer is any object with count(where) and page(offset, limit, where), or page(offset, limit, where, order) if the option `order` is given; it
is named by an importable name. Spark tests pushed comparisons again, so a layer that ignores a condition gives right rows too. A layer
that grows while it is read loses nothing: the last partition reads on until a page is empty.
"""

from __future__ import annotations

import datetime as dt
import importlib
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from fluvia.operators.graph import _step


def layer_of(name: str):
    """'package.module:attribute' to the object."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def with_retries(call, attempts: int = 3, wait: float = 0.5):
    """The call's result; an exception, or a result with an error in its body, counts as a failure."""
    for k in range(attempts):
        try:
            out = call()
            if isinstance(out, dict) and "error" in out:
                raise OSError(str(out["error"]))
            return out
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)


class Range(InputPartition):
    """Offsets from `begin` to before `end`; the last has no end."""

    def __init__(self, begin: int, end: int | None):
        self.begin, self.end = begin, end


#: Comparisons that a layer understands.
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _literal(v) -> str | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
    if isinstance(v, dt.date):
        return f"DATE '{v:%Y-%m-%d}'"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else None


def condition(f) -> str | None:
    """A pushed comparison as a layer's condition, or None if it has none."""
    sign = _SIGNS.get(type(f))
    if sign is None or len(f.attribute) != 1 or (text := _literal(f.value)) is None:
        return None
    return f"{f.attribute[0]} {sign} {text}"


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.where = options["layer"], options.get("where", "1=1")
        self.size, self.each = int(options.get("page", 1000)), int(options.get("partition", 10_000))
        self.attempts, self.order = int(options.get("retries", 3)), options.get("order")

    def partitions(self) -> list[Range]:
        n = with_retries(lambda: layer_of(self.name).count(self.where), self.attempts)
        begins = list(range(0, n, self.each)) or [0]
        return [*(Range(a, b) for a, b in zip(begins, begins[1:], strict=False)), Range(begins[-1], None)]

    def read(self, part: Range) -> Iterator[tuple]:
        layer, at = layer_of(self.name), part.begin
        order = (self.order,) if self.order else ()
        while part.end is None or at < part.end:
            size = self.size if part.end is None else min(self.size, part.end - at)
            rows = with_retries(lambda at=at, size=size: layer.page(at, size, self.where, *order), self.attempts)
            if not rows:
                return
            yield from rows
            at += len(rows)


class PushingReader(PagedReader):
    """For sessions where spark.sql.python.filterPushdown.enabled is on: Spark refuses a reader with this method elsewhere."""

    def pushFilters(self, filters):
        """Conditions go to the layer; all are tested again by Spark, since layers differ in how they compare."""
        for f in filters:
            if text := condition(f):
                self.where = text if self.where == "1=1" else f"{self.where} AND {text}"
            yield f


class PagedLayer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_layer"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> PagedReader:
        return (PushingReader if self.options.get("push") == "true" else PagedReader)(self.options)


def best_read(reads: list[DataFrame], key: str) -> DataFrame:
    """Of several reads of one layer the one with most distinct keys, each key once."""
    counts = [r.agg(F.countDistinct(key)).first()[0] for r in reads]
    return reads[max(range(len(reads)), key=lambda k: (counts[k], -k))].dropDuplicates([key])


def state_first(name: str, state: str, processed: str) -> str:
    """A file of the state folder, or else of the processed one."""
    return path if os.path.exists(path := os.path.join(state, name)) else os.path.join(processed, name)


def missing_cells(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be fetched."""
    return wanted.join(cached, keys, "left_anti")


def issue_form(c):
    """'### Heading' text to a map of headings to answers."""
    parts = F.filter(F.split(c, r"(?m)^### "), lambda s: F.trim(s) != "")
    return F.map_from_entries(F.transform(parts, lambda s: F.struct(F.trim(F.substring_index(s, "\n", 1)), F.btrim(F.regexp_replace(s, r"^[^\n]*\n", ""), F.lit(" \n\r\t")))))


def newest_first(spark, layer: str, schema: str, time: str, since=None, limit: int | None = None) -> DataFrame:
    """Rows of a layer by `time`, newest first: those at or after `since`, a pushed filter; or the newest `limit` where none is given."""
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    x = spark.read.format("paged_layer").option("layer", layer).option("schema", schema).option("order", f"{time} DESC").option("push", push).load()
    if since is not None:
        x = x.filter(F.col(time) >= F.lit(since))
    x = x.orderBy(F.col(time).desc())
    return x if limit is None else x.limit(limit)


def fetched_with_cache(wanted: DataFrame, cache: str, keys: list[str], fetch, schema: str, fresh: tuple[str, object] | None = None) -> DataFrame:
    """The wanted keys' rows from a cache of Parquet files, which is filled first.

    `fetch` gets an iterator of pandas batches of missing keys and gives batches of rows; a batch that fails should give none, so the next call
    tries its keys again. `fresh` (column, oldest) says which cached rows still count; of several for a key and the other columns all are kept.
    """
    spark = wanted.sparkSession

    def cached() -> DataFrame:
        try:
            x = spark.read.schema(schema).parquet(cache)
        except AnalysisException:  # there is none yet
            x = spark.createDataFrame([], schema)
        return x if fresh is None else x.filter(F.col(fresh[0]) >= F.lit(fresh[1]))

    todo = missing_cells(wanted.select(*keys).distinct(), cached().select(*keys).distinct(), keys)
    todo.mapInPandas(fetch, schema).write.mode("append").parquet(cache)
    return cached().join(wanted.select(*keys).distinct(), keys, "left_semi")


def fetch_error(e: Exception) -> str:
    """A short label of a failed request, to be counted: the status of the answer, or what kind of error it was."""
    code = getattr(e, "code", None) or getattr(getattr(e, "response", None), "status_code", None)
    return f"HTTP {code}" if code else type(e).__name__


def fetched_in_batches(wanted: DataFrame, cache: str, keys: list[str], ask, schema: str, size: int = 50, attempts: int = 3, fresh: tuple[str, object] | None = None, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The wanted keys' rows from a cache that is filled first by requests for `size` keys each, and the keys that could not be had with the label of their error.

    `ask` gets a list of key tuples and gives rows as dicts; it runs on the executors. A batch that fails after its attempts is skipped and tried again by
    the next call. The cache may be partitioned, say by cell and year. `fresh` (column, oldest) says which cached rows still count.
    """
    spark = wanted.sparkSession
    names = spark.createDataFrame([], schema).columns

    def cached() -> DataFrame:
        try:
            x = spark.read.schema(schema).parquet(cache)
        except AnalysisException:  # there is none yet
            x = spark.createDataFrame([], schema)
        return x if fresh is None else x.filter(F.col(fresh[0]) >= F.lit(fresh[1]))

    def run(frames):
        waiting: list[tuple] = []

        def answered(some):
            try:
                rows = [{**r, "_error": None} for r in with_retries(lambda: ask(some), attempts, 0.0 if attempts == 1 else 0.5)]
            except Exception as e:  # noqa: BLE001  the label says what it was
                rows = [{**dict(zip(keys, k, strict=True)), "_error": fetch_error(e)} for k in some]
            return pd.DataFrame(rows, columns=[*names, "_error"])

        for f in frames:
            waiting += list(f[keys].itertuples(index=False, name=None))
            while len(waiting) >= size:
                yield answered(waiting[:size])
                waiting = waiting[size:]
        if waiting:
            yield answered(waiting)

    todo = missing_cells(wanted.select(*keys).distinct(), cached().select(*keys).distinct(), keys)
    got = _step(todo.mapInPandas(run, f"{schema}, _error string"))  # asked once
    out = got.filter("_error IS NULL").drop("_error").write.mode("append")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(cache)
    return cached().join(wanted.select(*keys).distinct(), keys, "left_semi"), got.filter("_error IS NOT NULL").select(*keys, F.col("_error").alias("error"))
