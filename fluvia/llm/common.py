"""Shared plumbing of the training-data operators.

* written tables in the shared folder (never a machine-local one on a cluster);
* lookups that survive hot keys;
* readers that accept tables with nulls, extra columns and repeated rows.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid
from contextlib import contextmanager, suppress
from itertools import count
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine (tests, a laptop).
DEFAULT_SHARED = "file:///tmp/checkpoints/fluvia"

#: A key is hot when it holds more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot keys,
#: whatever the input: the proven bound of every broadcast in `hot_lookup`.
HOT_SHARE = 1000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Only a local master may leave it unset; on a cluster that is an error,
    since other executors could not see a machine's own folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or DEFAULT_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/fluvia-{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing_tables(spark: SparkSession, keep: list[DataFrame]):
    """Delete the tables written inside but those in `keep` (filled inside), and let Spark drop shuffle files that nothing
    refers to any more: nothing lazy that reads them may leave."""
    before = set(_written)
    yield
    held = {getattr(df, "_written_to", "") for df in keep}
    for path in [p for p in _written if p not in before and p not in held]:
        _written.remove(path)
        delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; for callers that hold their results elsewhere."""
    while _written:
        delete(spark, _written.pop())


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the table that `df` is, if `written` wrote it."""
    path = getattr(df, "_written_to", None)
    if path in _written:
        _written.remove(path)
        delete(spark, path)


def tidied(make, keep: tuple[str, ...] = ()) -> DataFrame:
    """The DataFrame that `make` gives; of the tables written meanwhile only those stay that it reads, and those in `keep`."""
    before = set(_written)
    out = make()
    read = out.inputFiles()
    held = lambda path: any(f"/{path.rstrip('/').rpartition('/')[2]}/" in f for f in read) or path in keep  # noqa: E731  folders have names of their own
    for path in [p for p in _written if p not in before and not held(p)]:
        _written.remove(path)
        delete(out.sparkSession, path)
    return out


@atexit.register
def _tidy() -> None:
    """At exit nothing lazy is left to read them: in folders of the machine's file system the tables go here, in others with the session, if it lives."""
    session = SparkSession.getActiveSession()
    for p in _written:
        if urlparse(p).scheme in ("", "file"):
            shutil.rmtree(unquote(urlparse(p).path), ignore_errors=True)
        elif session is not None:
            with suppress(Exception):
                delete(session, p)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hot_lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, salt: Column, share: int = HOT_SHARE) -> DataFrame:
    """Left join on a string or binary key, where a key may hold a third of the left rows.

    `right` has one row per key with `count` left rows each. Keys with more than total / share rows
    (fewer than `share` of them, by counting) are broadcast; their left rows then get a private join key, so
    that the shuffled join sees no key with more than that share.
    """
    cols = [c for c in right.columns if c != key]
    hot = right.filter(F.col(count) * share > F.lit(total))
    hot = hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols])
    rest = right.filter(F.col(count) * share <= F.lit(total))
    rest = rest.select(F.col(key).alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    x = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    own = F.concat(F.lit("#"), F.coalesce(salt.cast("string"), F.lit("")))
    x = x.withColumn("_jk", F.when(F.col("_hk").isNotNull(), own.cast(left.schema[key].dataType)).otherwise(F.col(key)))
    x = x.join(rest, F.col("_jk") == F.col("_rk"), "left")
    return x.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in cols])


class Bitmap:
    """Hashed membership of a column, for filters that may let others through: false means surely not in.

    Its size is a power of two between 2**16 and `most` bits (32 MB by default, the bound of what is broadcast); a set that fills it
    only weakens the filter. Executors build it in blocks of BLOCK bits, so the driver gets as many rows as there are blocks.
    """

    LEAST, MOST, BLOCK = 16, 28, 1 << 19

    def __init__(self, held: DataFrame, column: str, n: int):
        self.bits = 1 << min(self.MOST, max(self.LEAST, (16 * n).bit_length()))
        block, at = self.BLOCK, self._at(column)

        def build(batches):
            found: dict[int, np.ndarray] = {}
            for b in batches:
                k = b.column("at").to_numpy()
                for i in np.unique(k // block).tolist():
                    bits = found.setdefault(i, np.zeros(block, dtype=bool))
                    bits[k[k // block == i] % block] = True
            for i, bits in found.items():
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        words = np.zeros(max(block, self.bits) // 8, dtype=np.uint8)
        x = held.select(at.alias("at")).distinct().repartition((F.col("at") / block).cast("long"))
        for r in x.mapInArrow(build, "block long, bits binary").toLocalIterator():
            words[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.words = held.sparkSession.sparkContext.broadcast(words.view("<u4"))

    def _at(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def maybe(self, column: str) -> Column:
        held = self.words

        @F.pandas_udf("boolean")
        def test(at: pd.Series) -> pd.Series:
            k = at.to_numpy()
            return pd.Series((held.value[k // 32] >> (k % 32).astype(np.uint32) & 1).astype(bool))

        return test(self._at(column))


def with_row_ids(docs: DataFrame, ids: str = "doc_id", nulls_first: bool = False) -> tuple[DataFrame, str, bool]:
    """`docs` with a column (its name is returned) that holds a different long in each row, in the order of `ids`, and whether it
    is that column itself: so where `ids` has no null and no repetition. Otherwise the rows are sorted by it (nulls last, or first)
    and by a hash of the text, numbered, and written.
    """
    name = fresh(docs, "row_id")
    each = docs.select(column(ids).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if each.filter("n > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(name, column(ids).cast("long")), name, True
    order = (column(ids).isNotNull() if nulls_first else column(ids).isNull(), column(ids), F.sha2(F.coalesce(column("text"), F.lit("")), 256))
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), "rows"), name, False


def least_hashed(df: DataFrame, name: str, most: int, ties: list[str], low: int = -(2**63)) -> DataFrame:
    """The `most` rows with the least values of `name`, which is a hash spread evenly from `low` to 2**63.

    A bound on the hash leaves about twice as many rows before they are sorted, so what tasks send does not grow with their number.
    """
    n = df.count()
    some = df.filter(F.col(name) < F.lit(int(low + (2**63 - low) * (2 * most / n)))) if n > 2 * most else df
    if n > 2 * most and some.count() < most:  # equal hashes in great number
        some = df
    return some.orderBy(name, *ties).limit(most)


def without(docs: DataFrame, gone: DataFrame, ids: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose `ids` is not in `gone` (one column). Texts that a bitmap clears are not shuffled.

    A null id is never in it, rows that share an id go together, an empty table on either side is fine, and columns of any name are kept
    as they are (see `fresh`).
    """
    held = written(gone.select(column(gone.columns[0]).cast("long").alias("gone")).filter("gone IS NOT NULL").distinct(), "gone")
    key, maybe = fresh(docs, "gone_key"), fresh(docs, "gone_maybe")
    x = docs.withColumn(key, column(ids).cast("long"))
    x = x.withColumn(maybe, column(key).isNotNull() & Bitmap(held, "gone", held.count()).maybe(key))
    tested = x.filter(column(maybe)).join(held.withColumnRenamed("gone", key).hint("merge"), key, "left_anti")
    return x.filter(~column(maybe)).unionByName(tested).select(*map(column, docs.columns))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges with a > b."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = both.withColumn("k", F.col("u").cast("string"))
    least = written(both.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
    x = hot_lookup(both, least, "k", "n", both.count(), F.xxhash64("u", "v"))
    m = F.least("m", "u")
    to = x.select(F.col("v").alias("a"), m.alias("b"), F.col("u").alias("u"))
    to = to.filter("a > u").select("a", "b") if large else to.select("a", "b").unionByName(x.select(F.col("u").alias("a"), m.alias("b")))
    return written(to.filter("a <> b").distinct(), "cc-edges")


#: Edges that one task may join (a few dozen bytes each there); more are joined in rounds.
FEW_EDGES = 1 << 18


def _components_in_one_task(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, most_rounds: int | None = None, few: int = FEW_EDGES) -> DataFrame:
    """node, label (smallest node of its connected component) of every node of the edges (a, b: longs).

    Up to `few` edges are joined by one task; more by alternating large-star and small-star rounds, where a node with a third of
    all edges is safe (see hot_lookup). Nothing but counts reaches the driver. An error if `most_rounds` don't suffice.
    """
    spark = edges.sparkSession
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "cc-edges")
    if e.count() <= few:
        return e.coalesce(1).mapInArrow(_components_in_one_task, "node long, label long")
    for k in count():
        if k == most_rounds:
            raise RuntimeError(f"unfinished after {most_rounds} rounds")
        kept: list[DataFrame] = []
        old = e._written_to
        with passing_tables(spark, kept):
            e = _star(_star(e, True), False)
            kept.append(e)
        _written.remove(old)
        delete(spark, old)
        # done when all are stars: one edge from each outer node, and no centre is an outer node
        centres = e.select(F.col("b").alias("a")).distinct()
        n, outer = e.agg(F.count("*"), F.countDistinct("a")).first()
        if n == outer and centres.join(e.select("a"), "a", "left_semi").isEmpty():
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
