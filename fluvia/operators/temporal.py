"""Joins and windows over time: as-of, validity, densified days, recursive decay, travel shifts."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.operators.graph import _step


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, strict: bool = True, until: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Each left row with the latest right row of its key before it.

    Without `until` this is a union and a running last value: one shuffle by key and one sort, no pair of rows is ever
    joined. With `until` (end of validity) a right row that is no longer valid gives nulls. `right` must have no two rows of one time and key.
    """
    carry = carry or [c for c in right.columns if c not in keys]
    side = F.lit(1 if strict else 0)  # of equal times, right rows come after a strict left row
    a = left.select(*left.columns, F.lit(None).cast(f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in right.select(*carry).schema)}>").alias("_r"), F.col(left_time).alias("_t"), F.lit(True).alias("_left"), F.lit(0 if strict else 1).alias("_o"))
    b = right.select(*keys, F.struct(*carry).alias("_r"), F.col(right_time).alias("_t"), F.lit(False).alias("_left"), side.alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_left")
    ok = F.lit(True) if until is None else F.col(f"_last.{until}") > F.col(left_time)
    return x.select(*left.columns, *[F.when(ok, F.col(f"_last.{c}")).alias(c) for c in carry])


def densify_days(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """One row per key and day between its first and last; values of absent days are null."""
    span = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return span.join(df, [*keys, day], "left")


def decay_index(df: DataFrame, keys: list[str], day: str, value: str, k: float = 0.85, out: str = "api") -> DataFrame:
    """acc = k * acc + value (null as 0) in order of days, for 0 < k < 1.

    Within blocks of days by one running sum of values scaled with powers of k; each block's end then decays into the next ones, which is the
    same sum over blocks. Linear in the days of a key, of which nothing is collected.
    """
    size = max(1, min(256, int(230 / -log(k))))  # powers of k stay far from the limits of a double
    block = f"{day}_block"  # of another name at each level
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1
    x = df.select(*keys, F.col(day).alias("_day"), F.coalesce(F.col(value), F.lit(0.0)).alias("_v")).withColumnRenamed("_day", day).withColumn("_i", number)
    x = x.withColumn(block, F.floor(F.col("_i") / size)).withColumn("_j", F.col("_i") % size)
    scale = F.pow(F.lit(k), F.col("_j").cast("double"))
    inside = F.sum(F.col("_v") / scale).over(Window.partitionBy(*keys, block).orderBy("_j").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_acc", inside * scale)
    ends = x.groupBy(*keys, block).agg(F.max_by("_acc", "_j").alias("_end"))
    whole = k**size
    carried = ends.withColumnRenamed("_end", "_sum") if whole < 1e-17 else decay_index(ends, keys, block, "_end", whole, "_sum")
    before = carried.select(*keys, (F.col(block) + 1).alias(block), F.col("_sum").alias("_before"))
    x = x.join(before, [*keys, block], "left")
    return x.select(*keys, day, (F.col("_acc") + scale * F.lit(k) * F.coalesce("_before", F.lit(0.0))).alias(out))


#: Rows whose sums one task holds.
ROWS_A_TASK = 1 << 18


def travel_shift(df: DataFrame, day: str, hours: str, value: str, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Move values forward by travel time, split over the two days that it falls between.

    With `tasks` the rows are dealt to so many by key and day before they are summed: where nearly every row has a sum of its own, a task then holds its share of them only.
    """
    days = F.floor(F.col(hours) / 24).cast("int")
    part = F.col(hours) / 24 - F.floor(F.col(hours) / 24)
    shifted = df.select(*keys, F.explode(F.array(F.struct(F.date_add(F.col(day), days).alias("d"), (F.col(value) * (1 - part)).alias("v")), F.struct(F.date_add(F.col(day), days + 1).alias("d"), (F.col(value) * part).alias("v")))).alias("_s"))
    shifted = shifted.select(*keys, F.col("_s.d").alias(day), F.col("_s.v").alias(value))
    if tasks:
        shifted = shifted.repartition(tasks, *keys, day)
    return shifted.groupBy(*keys, day).agg(F.sum(value).alias(value))


def lead_shift(sources: DataFrame, values: DataFrame, k: int, site: str = "site", day: str = "day", lead: str = "lead", value: str = "p") -> DataFrame:
    """root, day, exposure and missing at lead `k` from `sources` (root, site, weight, travel_h) and `values` (site, day, lead, value).

    What leaves a source on day S arrives in parts on the two days T that its travel time falls between, and what was known of S on the day of issue, k days before T, is
    the forecast of lead max(k - (T - S), 0). So a value of lead m serves the target T only if m is that lead: an equality on the lead,
    no range. exposure: noisy-or of weight times value, a value of an absent row as 0; missing: the share of the root's weight whose value is null.
    """
    shift = F.col("travel_h") / 24
    whole = F.floor(shift).cast("int")
    part = shift - whole
    legs = F.array(F.struct(whole.alias("late"), (1 - part).alias("share")), F.struct((whole + 1).alias("late"), part.alias("share")))
    legs = sources.select("root", site, "weight", F.explode(legs).alias("leg")).select("root", site, "weight", "leg.late", "leg.share").filter("share > 0")
    legs = legs.withColumn(lead, F.greatest(F.lit(k) - F.col("late"), F.lit(0)).cast(values.schema[lead].dataType))
    met = legs.join(values.select(site, day, lead, value), [site, lead]).withColumn("target", F.date_add(F.col(day), F.col("late")))
    each = met.groupBy("root", "target", site, "weight").agg(F.sum(F.col("share") * F.coalesce(F.col(value), F.lit(0.0))).alias("x"), F.sum(F.when(F.col(value).isNull(), F.col("share")).otherwise(0.0)).alias("gone"))
    x = F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(1.0)) * F.col("weight")
    total = sources.groupBy("root").agg(F.sum("weight").alias("total"))
    out = each.groupBy("root", "target").agg((1 - F.product(1 - x)).alias("exposure"), F.sum(F.col("gone") * F.col("weight")).alias("gone"))
    share = F.when(F.col("total") > 0, F.least(F.col("gone") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return out.join(total, "root").select("root", F.col("target").alias(day), "exposure", share.alias("missing"))


def last_non_null(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key and column the latest value that is not null."""
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def _running_counts(df: DataFrame, column: str) -> DataFrame:
    """column, _n, _before: how many rows have each value, and how many a smaller one.

    Values are dealt to ranges and summed within each; only the ranges' totals meet in one window.
    """
    n = df.groupBy(column).agg(F.count("*").alias("_n")).repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    n = _step(n)
    totals = n.groupBy("_p").agg(F.sum("_n").alias("_t"))
    base = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_base"))  # a row per range
    within = F.sum("_n").over(Window.partitionBy("_p").orderBy(column)) - F.col("_n")
    return n.withColumn("_w", within).join(F.broadcast(base), "_p").select(column, "_n", (F.col("_w") + F.col("_base")).alias("_before"))


def global_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank over the whole table; rows with equal values share the smallest."""
    return df.join(_running_counts(df, column).select(column, (F.col("_before") + 1).alias(out)), column)


def average_rank(df: DataFrame, column: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Rank with ties at their mean.

    Counts per distinct value come first, so windows run over values, not over rows; without keys, over ranges of values.
    """
    if not keys:
        ranks = _running_counts(df, column).select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
        return df.join(ranks, [column])
    n = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = n.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranks, [*keys, column])
