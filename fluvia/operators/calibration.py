"""Calibration of probabilities by groups: isotonic fits from blocks that merge, and Platt's sigmoid, as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.operators.graph import _step
from fluvia.operators.temporal import asof_join

_BLOCK = "grp string, lo double, hi double, w double, s double"


def _pooled(batches):
    """Pool adjacent violators over blocks in the order of (grp, lo): a stack of blocks for the group at hand, emitted when it ends."""
    names = ["grp", "lo", "hi", "w", "s"]
    at, stack = None, []

    def out():
        return pa.record_batch([pa.array(c, pa.string() if n == "grp" else pa.float64()) for c, n in zip(zip(*((at, *b) for b in stack), strict=True), names, strict=True)], names=names)

    for b in batches:
        for g, lo, hi, w, s in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if g != at:
                if stack:
                    yield out()
                at, stack = g, []
            stack.append((lo, hi, w, s))
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                _, hi2, w2, s2 = stack.pop()
                lo1, _, w1, s1 = stack.pop()
                stack.append((lo1, hi2, w1 + w2, s1 + s2))
    if stack:
        yield out()


def isotonic(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """grp, lo, hi, w, mean: the blocks of the non-decreasing fit of `y` on `x` in each group (as a string).

    Rows are summed by value first. Each range of values is pooled by itself, and what is left of all ranges of a group once more: pooling blocks of
    pooled values gives the fit on all of them, so a group with a third of all rows meets one task only as blocks. Nulls take no part.
    """
    sums = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(x).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    cells = sums.select("grp", "lo", F.col("lo").alias("hi"), "w", "s")
    parts = _step(cells.repartitionByRange("grp", "lo").sortWithinPartitions("grp", "lo").mapInArrow(_pooled, _BLOCK))
    whole = parts.repartition("grp").sortWithinPartitions("grp", "lo").mapInArrow(_pooled, _BLOCK)
    return whole.select("grp", "lo", "hi", "w", (F.col("s") / F.col("w")).alias("mean"))


def knots(blocks: DataFrame) -> DataFrame:
    """grp, x, y: both ends of each block, one where they are the same."""
    ends = F.array_distinct(F.array("lo", "hi"))
    return blocks.select("grp", F.explode(ends).alias("x"), F.col("mean").alias("y"))


def calibrated(df: DataFrame, group: str, x: str, table: DataFrame, out: str = "p") -> DataFrame:
    """`df` with the value of the knots (grp, x, y) at `x`: straight lines between them, flat beyond, null without knots. One sort by group and value; no row meets
    more than one knot."""
    w = Window.partitionBy("grp").orderBy("x")
    right = table.select(F.col("grp").alias("_g"), F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1"), F.row_number().over(w).alias("_n"))
    first = right.filter("_n = 1").select("_g", F.lit(float("-inf")).alias("_x0"), "_y0", F.lit(None).cast("double").alias("_x1"), F.lit(None).cast("double").alias("_y1"))
    right = right.drop("_n").unionByName(first).withColumn("_at", F.col("_x0"))
    left = df.withColumn("_g", F.col(group).cast("string")).withColumn("_v", F.col(x).cast("double"))
    met = asof_join(left, right, ["_g"], "_v", "_at", strict=False, carry=["_x0", "_y0", "_x1", "_y1"])
    line = F.col("_y0") + (F.col("_v") - F.col("_x0")) * F.try_divide(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))
    return met.select(*df.columns, F.when(F.col("_v").isNotNull(), F.coalesce(line, "_y0")).alias(out))


def platt(df: DataFrame, group: str, x: str, y: str, rounds: int = 12, ridge: float = 1e-6) -> DataFrame:
    """grp, a, b of sigmoid(a * x + b) in each group, by Newton steps on sums; every step is one aggregation, and a group is a row."""
    data = _step(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(x).cast("double").alias("x")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s")))
    at = data.select("grp").distinct().withColumns({"a": F.lit(1.0), "b": F.lit(0.0)})
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("a") * F.col("x") + F.col("b"), F.lit(35.0)), F.lit(-35.0))))
        r = data.join(at, "grp").withColumn("g", F.col("s") - F.col("w") * p).withColumn("h", F.col("w") * p * (1 - p) + 1e-12)
        sums = r.groupBy("grp", "a", "b").agg(F.sum(F.col("g") * F.col("x")).alias("ga"), F.sum("g").alias("gb"), (F.sum(F.col("h") * F.col("x") * F.col("x")) + ridge).alias("aa"), F.sum(F.col("h") * F.col("x")).alias("ab"), (F.sum("h") + ridge).alias("bb"))
        d = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
        held = lambda c: F.greatest(F.least(c, F.lit(4.0)), F.lit(-4.0))  # noqa: E731  a long step would overshoot
        at = _step(sums.select("grp", (F.col("a") + held(F.try_divide(F.col("bb") * F.col("ga") - F.col("ab") * F.col("gb"), d))).alias("a"), (F.col("b") + held(F.try_divide(F.col("aa") * F.col("gb") - F.col("ab") * F.col("ga"), d))).alias("b")))
    return at
