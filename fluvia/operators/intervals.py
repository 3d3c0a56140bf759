"""Intervals over time: which overlap, and the latest end before or in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider the buckets of each level are than those of the level below.
WIDER = 8


def _level(lo: Column, hi: Column, width: float, levels: int) -> Column:
    """The first level at which the interval touches two buckets at most: those no longer than one of its buckets."""
    out = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        out = F.when(hi - lo <= width * WIDER**k, F.lit(k)).otherwise(out)
    return out


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, start: str, end: str, width: float, levels: int = 6) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals [lo, hi] of `left` and [start, end] of `right` (numbers) meet.

    Right intervals go to the one or two buckets that they touch on the level that fits their length, so a long one is not copied into every short bucket, and
    left ones to their buckets on each level that the right side uses. A pair is made in the first bucket that both touch, and nowhere else. The
    join's key holds the bucket, so a key with a third of all rows falls apart by time. Columns of both sides but for the keys must have names of their own;
    rows with a null key or end meet nothing.
    """
    per = lambda level: F.lit(width) * F.pow(F.lit(float(WIDER)), level)
    bucket = lambda c, level: F.floor(F.col(c) / per(level))
    b = right.filter(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(start), F.col(end), width, levels))
    b = b.withColumn("_from", bucket(start, F.col("_level")))
    b = b.withColumn("_bucket", F.explode(F.sequence("_from", bucket(end, F.col("_level")))))
    a = left.filter(F.col(lo) <= F.col(hi)).withColumn("_level", F.explode(F.array(*map(F.lit, range(levels)))))
    a = a.withColumn("_begin", bucket(lo, F.col("_level")))
    a = a.withColumn("_bucket", F.explode(F.sequence("_begin", bucket(hi, F.col("_level")))))
    met = a.join(b, [*keys, "_level", "_bucket"]).filter(f"_bucket = greatest(_begin, _from) AND `{start}` <= `{hi}` AND `{end}` >= `{lo}`")
    return met.drop("_level", "_bucket", "_begin", "_from")


def latest_end(windows: DataFrame, events: DataFrame, keys: list[str], lo: str, hi: str, start: str, end: str, block: float, out: str = "last") -> DataFrame:
    """`windows` with the latest `end` of the events of its key that overlap [lo, hi], or null.

    Of the events that begin by `hi`, the latest end decides: if it lies before `lo`, none overlaps. So no pair is made: windows and events are put
    in one order and a running maximum is taken, inside blocks of time of each key, and over the blocks' maxima, of which a key has as many as blocks.
    Equal times: an event that begins at `hi` counts. A key with a third of all rows is sorted block by block, by many tasks.
    """
    both = F.struct(*windows.columns)
    none = F.lit(None)
    a = windows.select(*keys, F.col(hi).cast("double").alias("_t"), none.cast("double").alias("_end"), F.lit(1).alias("_o"), both.alias("_row"))
    b = events.select(*keys, F.col(start).cast("double").alias("_t"), F.col(end).cast("double").alias("_end"), F.lit(0).alias("_o"), none.cast(a.schema["_row"].dataType).alias("_row"))
    x = a.unionByName(b.filter(F.col("_t").isNotNull() & F.col("_end").isNotNull())).withColumn("_block", F.floor(F.col("_t") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.max("_end").over(inside))
    # a block's maximum reaches the later ones
    ends = b.withColumn("_block", F.floor(F.col("_t") / block)).groupBy(*keys, "_block").agg(F.max("_end").alias("_m"))
    asked = a.withColumn("_block", F.floor(F.col("_t") / block)).select(*keys, "_block").distinct()
    marks = ends.unionByName(asked.withColumn("_m", none.cast("double"))).groupBy(*keys, "_block").agg(F.max("_m").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.select(*keys, "_block", F.max("_m").over(earlier).alias("_before"))
    x = x.filter(F.col("_row").isNotNull()).join(before, [*keys, "_block"], "left").withColumn("_last", F.greatest("_in", "_before"))
    return x.select("_row.*", F.when(F.col("_last") >= F.col(f"_row.{lo}"), F.col("_last")).alias(out))


def overlap_totals(windows: DataFrame, events: DataFrame, keys: list[str], by: list[str], lo: str, hi: str, start: str, end: str, block: int) -> DataFrame:
    """Of each `by`, over its windows: `n` events of the same keys whose closed [start, end] meets [lo, hi], and the length `total` that they have in common; the windows' other columns are summed.

    Ends are whole numbers, sums are exact. No pair is made: the events that meet a window are those begun by `hi` less those ended before `lo`, and the common length is what the events
    cover up to `hi` less what they cover up to `lo`. Both are running sums over one order of all ends, inside blocks of time of each key, and over the blocks' sums, of which a
    key has as many as blocks. A key with a third of all rows is sorted block by block, by many tasks. Windows with a null key or end are left out.
    """
    rest = [c for c in windows.columns if c not in {*keys, *by, lo, hi}]
    # at equal times: events' starts, windows' ends, events' ends
    mark = lambda c, o, cols=(): F.struct(F.col(c).cast("long").alias("_t"), F.lit(o).alias("_o"), *cols)
    none = [F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in rest]
    blocked = lambda df: df.select(*[c for c in df.columns if c != "_m"], "_m.*").withColumn("_block", F.floor(F.col("_t") / F.lit(block)))
    a = blocked(windows.filter(F.col(lo) <= F.col(hi)).select(*keys, *by, F.explode(F.array(mark(lo, 1, none), mark(hi, 2, [F.col(c) for c in rest]))).alias("_m")))
    b = blocked(events.filter(F.col(start) <= F.col(end)).select(*keys, F.explode(F.array(mark(start, 0), mark(end, 3))).alias("_m")))
    t, o = F.col("_t").cast("decimal(18,0)"), F.col("_o")
    parts = {"_begun": F.sum((o == 0).cast("long")), "_ended": F.sum((o == 3).cast("long")), "_sum": F.sum(F.when(o == 0, t).when(o == 3, -t).otherwise(F.lit(0).cast("decimal(18,0)")))}
    inside = Window.partitionBy(*keys, "_block").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = a.unionByName(b, allowMissingColumns=True)
    x = x.select("*", *[v.over(inside).alias(k) for k, v in parts.items()]).filter(o.isin(1, 2))
    # a block's sums reach the later ones
    sums = b.groupBy(*keys, "_block").agg(*[v.alias(k) for k, v in parts.items()]).unionByName(a.select(*keys, "_block").distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", *[F.sum(k).over(earlier).alias(f"{k}_before") for k in parts]).dropDuplicates([*keys, "_block"])
    x = x.join(sums, [*keys, "_block"])
    begun, ended, gone = (F.col(k) + F.coalesce(F.col(f"{k}_before"), F.lit(0)) for k in parts)
    covered = t * (begun - ended).cast("decimal(19,0)") - gone
    n, total = F.when(o == 2, begun).otherwise(-ended), F.when(o == 2, covered).otherwise(-covered)
    return x.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(total).alias("total"), *[F.sum(c).alias(c) for c in rest])
