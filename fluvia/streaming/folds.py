"""Polls folded into state: the same functions for a batch and for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(events: DataFrame) -> DataFrame:
    """user_id, day, n, slots: polls counted and half hours as a 48-bit mask."""
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int")
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)).alias("slots"))


def merge_coverage(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Counts add, masks OR."""
    new = coverage(batch)
    if state is None:
        return new
    return state.unionByName(new).groupBy("user_id", "day").agg(F.sum("n").alias("n"), F.bit_or("slots").alias("slots"))


class CoverageFold:
    """foreachBatch sink: each batch id is folded once, into a new version of the state; a replayed batch changes nothing."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        target = f"{self.path}/v={batch_id}"
        previous = None if batch_id == 0 else batch.sparkSession.read.parquet(f"{self.path}/v={batch_id - 1}")
        merge_coverage(previous, batch.dropDuplicates(["event_id"])).write.mode("overwrite").parquet(target)


def windowed_counts(stream: DataFrame, late: str = "6 hours") -> DataFrame:
    """Half-hour counts with a watermark, for a stream or a table."""
    x = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return (x.withWatermark("ts", late) if x.isStreaming else x).groupBy(F.window("ts", "30 minutes"), "event_type").agg(F.count("*").alias("n"))


def carry_forward(previous: DataFrame | None, polled: DataFrame) -> DataFrame:
    """The rows of this poll (site_id, company, status, status_start, fetched_at), and of companies that it lacks altogether the last known rows: their status is -3
    (not known), and `down_since` is the time of the first poll that lacked them. A company that returns has no down_since."""
    now = polled.agg(F.max("fetched_at").alias("_now"))  # one row
    new = latest_poll(polled).withColumn("down_since", F.lit(None).cast(polled.schema["fetched_at"].dataType))
    if previous is None:
        return new
    gone = previous.join(polled.select("company").distinct(), "company", "left_anti").crossJoin(F.broadcast(now))
    gone = gone.withColumns({"status": F.lit(-3).cast(polled.schema["status"].dataType), "down_since": F.coalesce("down_since", "_now")})
    return new.unionByName(gone.select(*new.columns))


def latest_poll(polled: DataFrame) -> DataFrame:
    """One row per site, the last fetched."""
    last = polled.groupBy("site_id").agg(F.max_by(F.struct(*[c for c in polled.columns if c != "site_id"]), F.struct("fetched_at", "status", "status_start")).alias("_r"))
    return last.select("site_id", "_r.*").select(*polled.columns)


def history(polled: DataFrame) -> DataFrame:
    """Rows with the day of the poll where there is no status start: the key by which the event log keeps one row."""
    return polled.withColumn("day_key", F.when(F.col("status_start").isNull(), F.to_date("fetched_at")))


def settled_history(rows: DataFrame) -> DataFrame:
    """Of each site, status and status start (or day) the row fetched last."""
    key = ["site_id", "status", "status_start", "day_key"]
    return rows.groupBy(*key).agg(F.max("fetched_at").alias("fetched_at"), F.max_by("company", "fetched_at").alias("company")).select("site_id", "company", "status", "status_start", "fetched_at", "day_key")


def poll_coverage(state: DataFrame | None, polled: DataFrame) -> DataFrame:
    """site_id, day, n, n_known, slots: polls counted, known ones apart, their half hours as a mask."""
    slot = (F.hour("fetched_at") * 2 + F.floor(F.minute("fetched_at") / 30)).cast("int")
    known = F.col("status") >= 0
    mask = F.when(known, F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)).otherwise(F.lit(0).cast("bigint"))
    new = polled.groupBy("site_id", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(known).alias("n_known"), F.bit_or(mask).alias("slots"))
    both = new if state is None else state.unionByName(new)
    return both.groupBy("site_id", "day").agg(F.sum("n").alias("n"), F.sum("n_known").alias("n_known"), F.bit_or("slots").alias("slots"))


def poll_log(polled: DataFrame, batch_id: int) -> DataFrame:
    """batch, company, n, n_known of one poll."""
    return polled.groupBy("company").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 0).alias("n_known")).select(F.lit(batch_id).cast("long").alias("batch"), "company", "n", "n_known")


def live_log(path: str, merge_after: int = 16):
    """The four tables of a live feed, written from one poll and committed together."""
    from fluvia.streaming.batchlog import Appended, BatchLog, Folded

    return BatchLog(path, {
        "snapshot": Folded(lambda state, polled, _: carry_forward(state, polled)), "history": Appended(lambda polled, _: history(polled), settled_history),
        "coverage": Folded(lambda state, polled, _: poll_coverage(state, polled)), "polls": Appended(poll_log),
    }, merge_after)
