"""A store of links by square tiles: records coded as differences, a packed index for each tile, and a reader that opens only the tiles of a box.

    <path>/records/tx=../ty=../   link, code: triples (difference of source numbers, distance in tens, share in ten-thousandths)
    <path>/index/tx=../ty=../     block: the tile's links, little-endian
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units of coded distances and shares. Fixed values.
DISTANCE_UNIT, SHARE_UNIT = 10, 10_000


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def encoded(records: DataFrame) -> DataFrame:
    """link, code of `records` (link, source, base, share; one row per link and source)."""
    rows = F.sort_array(F.collect_list(F.struct("source", _half_up(F.col("base") / DISTANCE_UNIT).alias("b"), _half_up(F.col("share") * SHARE_UNIT).alias("r"))))
    before = lambda i: F.coalesce(F.get("rows", i - 1)["source"], F.lit(0).cast("long"))
    triples = F.transform("rows", lambda v, i: F.array((v["source"] - before(i)).cast("long"), v["b"], v["r"]))
    return records.withColumn("source", F.col("source").cast("long")).groupBy("link").agg(rows.alias("rows")).select("link", F.flatten(triples).alias("code"))


def decoded(coded: DataFrame) -> DataFrame:
    """link, source, base, share of rows (link, code), to the units of the code."""
    x = coded.filter("size(code) > 0").select("link", F.explode(F.sequence(F.lit(0), (F.size("code") / 3).cast("int") - 1)).alias("i"), "code")
    at = lambda k: F.get("code", F.col("i") * 3 + k)
    x = x.select("link", "i", at(0).alias("d"), (at(1) * DISTANCE_UNIT).cast("double").alias("base"), (at(2) / SHARE_UNIT).alias("share"))
    running = Window.partitionBy("link").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("link", F.sum("d").over(running).alias("source"), "base", "share")


#: Of a tile's block: its number of links, then for each of these columns all links' values.
BLOCK = (("link", "<i8"), ("x", "<f8"), ("y", "<f8"), ("upstream", "<f4"))


def packed(table: pa.Table) -> bytes:
    """A tile's links in ascending order as one block."""
    table = table.sort_by("link")
    return np.int32(table.num_rows).astype("<i4").tobytes() + b"".join(table.column(c).to_numpy().astype(kind).tobytes() for c, kind in BLOCK)


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(block, "<i4", 1)[0]), 4, {}
    for c, kind in BLOCK:
        out[c] = np.frombuffer(block, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _tile(size: float) -> list[Column]:
    return [F.floor(F.col("x") / size).cast("int").alias("tx"), F.floor(F.col("y") / size).cast("int").alias("ty")]


def write(links: DataFrame, records: DataFrame, path: str, size: float) -> None:
    """Write `links` (link, x, y, upstream) and their `records` by tiles of `size`. A tile's index is one value, so a tile must be small enough for a task; its
    records are not together in one."""
    placed = links.select("link", *_tile(size))
    coded = encoded(records).join(placed, "link")
    coded.repartition("tx", "ty", F.pmod(F.xxhash64("link"), F.lit(8))).write.partitionBy("tx", "ty").parquet(f"{path}/records")

    def block(t: pa.Table) -> pa.Table:
        return pa.table({"tx": t.column("tx").slice(0, 1), "ty": t.column("ty").slice(0, 1), "block": pa.array([packed(t)], pa.binary())})

    rows = links.select(F.col("link").cast("long").alias("link"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "upstream")], *_tile(size))
    rows.groupBy("tx", "ty").applyInArrow(block, "tx int, ty int, block binary").write.partitionBy("tx", "ty").parquet(f"{path}/index")


def _of_box(spark: SparkSession, path: str, size: float, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = box
    inside = " AND ".join(f"{c} BETWEEN {int(np.floor(lo / size))} AND {int(np.floor(hi / size))}" for c, lo, hi in (("tx", x0, x1), ("ty", y0, y1)))
    return spark.read.parquet(path).filter(inside)


def links_in(spark: SparkSession, path: str, size: float, box: tuple[float, float, float, float]) -> DataFrame:
    """link, x, y, upstream of the links whose point lies in the closed box (x0, y0, x1, y1)."""

    def run(batches):
        for b in batches:
            for blob in b.column("block").to_pylist():
                t = unpacked(blob)
                yield pa.record_batch([pa.array(t[c].astype(np.float64) if c != "link" else t[c]) for c, _ in BLOCK], names=[c for c, _ in BLOCK])

    x0, y0, x1, y1 = box
    out = _of_box(spark, f"{path}/index", size, box).select("block").mapInArrow(run, "link long, x double, y double, upstream double")
    return out.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def records_in(spark: SparkSession, path: str, size: float, box: tuple[float, float, float, float]) -> DataFrame:
    """link, source, base, share of those links: only the partitions of the box's tiles are read."""
    coded = _of_box(spark, f"{path}/records", size, box).select("link", "code")
    return decoded(coded.join(links_in(spark, path, size, box).select("link"), "link", "left_semi"))
