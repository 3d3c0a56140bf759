"""What lies upstream of each root, kept in a partitioned table and retraced only where sources changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.operators.graph import _step, closure, reversed_edges


def traced(edges: DataFrame, roots: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """root, source, dist: `sources` (source, node) within `cap` above each of `roots` (node), and for each root a row without a source, so that a root
    that loses all of them still has its place."""
    x = closure(edges, roots, cap).join(sources.select("source", "node"), "node").select("root", "source", "dist")
    none = roots.select(F.col("node").alias("root"), F.lit(None).cast(dict(sources.dtypes)["source"]).alias("source"), F.lit(None).cast("double").alias("dist"))
    return x.unionByName(none.distinct())


def build(edges: DataFrame, roots: DataFrame, sources: DataFrame, cap: float, path: str, tile: Column) -> None:
    """Write `traced` to `path`, a partition for each value of `tile` (an expression on root)."""
    traced(edges, roots, sources, cap).withColumn("tile", tile).repartition("tile").write.partitionBy("tile").parquet(path)


def changed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """node: where a source (source, node) was added, removed, or moved from or to."""
    a, b = (x.select("source", "node").distinct() for x in (old, new))
    return a.subtract(b).unionByName(b.subtract(a)).select("node").distinct()


def retrace(edges: DataFrame, roots: DataFrame, old: DataFrame, new: DataFrame, cap: float, path: str, tile: Column) -> DataFrame:
    """Bring the table at `path` from the sources `old` to `new`; the roots that were traced anew (node).

    Only roots that a changed node reaches within the cap can change. Their rows are traced again, other rows of their partitions carried over, and those partitions alone
    overwritten: files of the others keep their names.
    """
    spark = edges.sparkSession
    changed = _step(changed_nodes(old, new))
    reached = closure(reversed_edges(edges), changed, cap).select("node").distinct()
    redo = _step(roots.select("node").distinct().join(reached, "node", "left_semi"))
    if redo.isEmpty():
        return redo
    tiles = redo.withColumnRenamed("node", "root").select(tile.alias("tile")).distinct()
    held = spark.read.parquet(path).join(tiles, "tile", "left_semi").join(redo.withColumnRenamed("node", "root"), "root", "left_anti").select("root", "source", "dist")
    fresh = _step(held.unionByName(traced(edges, redo, new, cap)).withColumn("tile", tile))  # the table is not read and written at once
    fresh.repartition("tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(path)
    return redo


def table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("source IS NOT NULL").select("root", "source", "dist")
