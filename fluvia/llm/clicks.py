"""Expiring click deduplication: windows of repeats per click_id in a stateful streaming query.

The first event of a click_id opens a window; events up to `span` hours after its start, earlier ones included, repeat it; a later one closes it and opens
the next. Windows whose deadline the watermark has passed close by timeout. Lateness and timeouts come from Spark's own watermark, which the checkpoint
carries from one start of the query to the next; each feed is one start and one micro-batch. At the end two feeds of a sentinel push the watermark past
every deadline.

State is held per key of `applyInPandasWithState`: a key is one click_id, or, with `keys`, a hash bucket of them. Either way a window is its own
entry (click_id, start, counts, CRC, opener's hash), packed column by column into a tuple of bytes, and each click_id is folded by itself; a bucket only spares a call
of Python, an Arrow slice and a state row for each click_id. The timeout of a key is the earliest deadline of its windows. A key's rows of one micro-batch are
gathered from the chunks in which they come, equal rows counted together, and folded in the order of (hour, hash).

Edge cases: rows without click_id or arrival time have no key or hour and take no part; other nulls count as empty in the hash, a value that is not finite as
null; repeated rows are repeats of each other; ties of hour and hash are equal rows; negative ids have copies like others; an empty table gives an empty result; extra
columns are ignored. A click_id with a great share of a batch is folded by one task, as its order asks, in memory that grows with its distinct (hour, hash).
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from fluvia.llm import common

HOUR_MS = 3_600_000

#: Copies of all feeds that share a key of state, about: a few thousand a feed.
COPIES_A_KEY, LEAST_KEYS = 1 << 17, 96

#: Rows of a key that are gathered before equal ones are counted together.
GATHERED = 1 << 18

STATE = "ids binary, starts binary, repeats binary, conflicts binary, crcs binary, hashes binary"
WINDOWS = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"


@dataclass
class Windows:
    """Open windows, one row each, in columns."""

    ids: np.ndarray
    starts: np.ndarray
    repeats: np.ndarray
    conflicts: np.ndarray
    crcs: np.ndarray
    hashes: np.ndarray  # of four unsigned words each, most significant first

    @classmethod
    def unpacked(cls, state: tuple | None) -> Windows:
        state = state or (b"",) * 6
        longs = [np.frombuffer(x, dtype="<i8") for x in state[:5]]
        return cls(*longs, words(state[5]))

    def packed(self) -> tuple:
        longs = (self.ids, self.starts, self.repeats, self.conflicts, self.crcs)
        return (*(x.astype("<i8").tobytes() for x in longs), self.hashes.astype(">u8").tobytes())

    def take(self, which: np.ndarray) -> Windows:
        return Windows(*(x[which] for x in vars(self).values()))

    def rows(self, closed: np.ndarray | int) -> pd.DataFrame:
        raw = self.hashes.astype(">u8").tobytes()
        return pd.DataFrame({
            "click_id": self.ids, "start_hour": self.starts, "closed_batch": np.broadcast_to(np.int64(closed), len(self.ids)), "n_repeats": self.repeats,
            "n_conflicts": self.conflicts, "conflict_crc": self.crcs, "hash": [raw[k : k + 32] for k in range(0, len(raw), 32)],
        })


def words(raw: bytes) -> np.ndarray:
    """SHA-256 digests as rows of four words, which sort as the digests do."""
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 4)


def together(ids: np.ndarray, hours: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple:
    """Rows in the order of (id, hour, hash), equal ones as one with their number."""
    order = np.lexsort((*hashes.T[::-1], hours, ids))
    ids, hours, hashes, n = ids[order], hours[order], hashes[order], n[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hours[1:] != hours[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return ids[at], hours[at], hashes[at], np.add.reduceat(n, at) if len(at) else n


def fold(held: Windows, ids: np.ndarray, hours: np.ndarray, hashes: np.ndarray, n: np.ndarray, span: int) -> tuple[Windows, Windows]:
    """Windows that events close, and those open at the end. Events come from `together`.

    All ids advance side by side: each round gives every id's open window its repeats and lets the next event open another, so there are as
    many rounds as one id has windows in this batch, at most the batch's hours over the span.
    """
    own, first = np.unique(ids, return_index=True)
    last = np.append(first[1:], len(ids))
    low = int(hours.min()) if len(hours) else 0
    width = int(hours.max()) - low + 2 if len(hours) else 1
    segment = np.repeat(np.arange(len(own)), last - first)
    place = segment * width + (hours - low)  # rises with (id, hour)

    at = np.searchsorted(held.ids, own)
    known = at < len(held.ids)
    known[known] = held.ids[at[known]] == own[known]
    untouched = np.ones(len(held.ids), dtype=bool)
    untouched[at[known]] = False

    # windows in the order in which they are opened: those held, then one for each opener of each round
    win = held.take(at[known])
    ids_, starts_, hashes_ = [win.ids], [win.starts], [win.hashes]
    open_of = np.full(len(own), -1)
    open_of[known] = np.arange(int(known.sum()))
    start_of = np.zeros(len(own), dtype=np.int64)
    start_of[known] = win.starts
    begins, ends, whose, closed = [], [], [], []
    made, pos, active = int(known.sum()), first.copy(), np.arange(len(own))
    opened_at = []
    while len(active):
        has = open_of[active] >= 0
        with_open = active[has]
        reach = np.clip(start_of[with_open] + span - low, -1, width - 1)
        end = np.minimum(np.maximum(np.searchsorted(place, with_open * width + reach, side="right"), pos[with_open]), last[with_open])
        begins.append(pos[with_open])
        ends.append(end)
        whose.append(open_of[with_open])
        pos[with_open] = end
        opening = active[pos[active] < last[active]]
        closed.append(open_of[opening][open_of[opening] >= 0])
        opener = pos[opening]
        opened_at.append(opener)
        ids_.append(own[opening])
        starts_.append(hours[opener])
        hashes_.append(hashes[opener])
        open_of[opening] = made + np.arange(len(opening))
        made += len(opening)
        start_of[opening] = hours[opener]
        active = opening  # the opener is counted as a repeat of its own window, and taken off below
    every = Windows(np.concatenate(ids_), np.concatenate(starts_), *(np.zeros(made, dtype=np.int64) for _ in range(3)), np.concatenate(hashes_))
    for x, y in zip((every.repeats, every.conflicts, every.crcs), (win.repeats, win.conflicts, win.crcs), strict=True):
        x[: len(y)] = y
    begin, end, who = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (begins, ends, whose))
    size = end - begin
    row = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, dtype=np.int64)
    window = np.repeat(who, size)
    np.add.at(every.repeats, window, n[row])
    if opened_at:
        np.subtract.at(every.repeats, np.arange(len(win.ids), made), 1)
    odd = (hashes[row] != every.hashes[window]).any(axis=1)
    np.add.at(every.conflicts, window[odd], n[row[odd]])
    raw = hashes[row[odd]].astype(">u8").tobytes()
    crcs = np.fromiter((zlib.crc32(raw[k : k + 32].hex().encode()) for k in range(0, len(raw), 32)), dtype=np.int64, count=len(raw) // 32)
    np.add.at(every.crcs, window[odd], crcs * n[row[odd]])
    shut = np.zeros(made, dtype=bool)
    if closed:
        shut[np.concatenate(closed)] = True
    rest, stays = held.take(np.flatnonzero(untouched)), every.take(np.flatnonzero(~shut))
    still = Windows(*(np.concatenate([x, y]) for x, y in zip(vars(rest).values(), vars(stays).values(), strict=True)))
    return every.take(np.flatnonzero(shut)), still.take(np.argsort(still.ids, kind="stable"))


def _folding(run: int, last: int, span: int, zero: int):
    """The function of one feed. Its clock starts at the hour `zero`; windows past the watermark closed after the feed before."""

    def each(key, chunks, state):
        held = Windows.unpacked(state.get if state.exists else None)
        mark = state.getCurrentWatermarkMs()
        due = (held.starts + span - zero) * HOUR_MS - 1 < mark
        if due.any():
            yield held.take(np.flatnonzero(due)).rows(min(run - 1, last))
            held = held.take(np.flatnonzero(~due))
        parts: list[tuple] = []
        if not state.hasTimedOut:
            gathered = 0
            for c in chunks:
                # the sentinel has no click_id; with several stateful operators in mind, Spark drops late rows by the watermark of the batch before this
                c = c[c["click_id"].notna() & ((c["hour"] - zero) * HOUR_MS > mark)]
                if len(c):
                    parts.append((c["click_id"].to_numpy(np.int64), c["hour"].to_numpy(np.int64), words(b"".join(c["hash"])), np.ones(len(c), dtype=np.int64)))
                    gathered += len(c)
                if gathered > GATHERED:
                    parts = [together(*map(np.concatenate, zip(*parts, strict=True)))]
                    gathered = 0
        if parts:
            shut, held = fold(held, *together(*map(np.concatenate, zip(*parts, strict=True))), span)
            if len(shut.ids):
                yield shut.rows(run)
        if len(held.ids):
            state.update(held.packed())
            state.setTimeoutTimestamp(int((int(held.starts.min()) + span - zero) * HOUR_MS - 1))
        elif state.exists:
            state.remove()

    return each


def deduplicated(spark: SparkSession, base: str, schema: str, batches: int, span: int, wait: int, zero: int, keys: int | None) -> DataFrame:
    """Windows (WINDOWS) of the events (click_id, hour, at, hash) in the folders batch=0, 1 ... of `base`/feeds, fed in order; checkpoint and result lie below
    `base` too.

    Two feeds after the batches hold the sentinel. `at` is the hour on the clock that starts at `zero`, as a timestamp. An event is late when its hour
    is more than `wait` hours before the latest of the feeds before: the watermark lags a millisecond more, since Spark drops what equals it.
    """
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # a start is one micro-batch: timeouts come with the next feed
    try:
        for run in range(batches + 2):
            there = ",".join(map(str, range(run + 1)))  # the source as it stands: folders come, none goes
            events = spark.readStream.schema(schema).parquet(f"{base}/feeds/batch={{{there}}}").withWatermark("at", f"{wait} hours 1 millisecond")
            key = F.col("click_id") if keys is None else F.pmod(F.xxhash64("click_id"), F.lit(keys))
            folded = events.withColumn("key", key).groupBy("key").applyInPandasWithState(_folding(run, batches - 1, span, zero), WINDOWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
            query = folded.writeStream.format("parquet").option("path", f"{base}/windows").option("checkpointLocation", f"{base}/checkpoint").option("compression", "zstd").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            gc.collect()
            spark._jvm.System.gc()  # shuffle files of the feed go
    finally:
        spark.conf.set(setting, before)
    common.delete(spark, f"{base}/feeds")
    common.delete(spark, f"{base}/checkpoint")
    return spark.read.schema(WINDOWS).parquet(f"{base}/windows")


# --- the clicks table --------------------------------------------------------------------------------------------


def utc_micros(table: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, with a zone or, read as UTC, without."""
    c = common.column(name)
    if table.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(c)
    since = c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    parts = [F.extract(F.lit(unit), since) for unit in ("DAY", "HOUR", "MINUTE")]
    return ((parts[0] * 24 + parts[1]) * 60 + parts[2]).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, late (hour of delivery), hash of the copies of each row."""
    x = clicks.select(
        F.col("click_id").cast("long").alias("click_id"), utc_micros(clicks, "arrived_at").alias("arrived"), utc_micros(clicks, "ts").alias("ts"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("client_id", "kind", "props")], F.col("value").cast("double").alias("value"),
    ).filter("click_id IS NOT NULL AND arrived IS NOT NULL")
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))))
    x = x.withColumn("c", F.crc32(F.concat_ws(":", "click_id", "j").cast("binary")))
    cents = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < 9e16), F.floor(F.col("value") * 100 + 0.5).cast("string"))
    parts = [F.coalesce(p, F.lit("")) for p in (F.col("client_id"), F.col("kind"), cents, F.col("ts").cast("string"), F.col("props"), F.pmod("c", F.lit(3)).cast("string"))]
    hour = F.floor(F.col("arrived") / 3_600_000_000) + F.col("j") * 6 * F.pmod("c", F.lit(10))
    x = x.select("click_id", hour.cast("long").alias("hour"), "c", F.unhex(F.sha2(F.concat_ws("|", *parts), 256)).alias("hash"))
    return x.withColumn("late", F.col("hour") + F.pmod(F.floor(F.col("c") / 10), F.lit(200)))


def click_windows(clicks: DataFrame, batches: int = 12, span: int = 72, wait: int = 48, keys: int | None = 0) -> DataFrame:
    """Windows of the copies of `clicks`, cut into `batches` feeds by the hour of delivery.

    `keys`: buckets of click_ids that share a key of state; 0 takes one for each COPIES_A_KEY copies, None makes each click_id a key.
    """
    spark = clicks.sparkSession
    base = common.new_path(spark, "clicks")
    all_copies = copies(clicks)
    low, high, zero, latest, n = all_copies.agg(F.min("late"), F.max("late"), F.min("hour"), F.max("hour"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], WINDOWS)
    zero -= 1  # so that no event is at 0, where the watermark starts
    at = F.timestamp_seconds((F.col("hour") - zero) * 3600).alias("at")
    batch = F.floor((F.col("late") - low) * batches / (high - low + 1)).cast("int").alias("batch")
    event = "click_id long, hour long, at timestamp, hash binary"
    all_copies.select("click_id", "hour", at, "hash", batch).write.partitionBy("batch").option("compression", "zstd").parquet(f"{base}/feeds")
    past = latest + span + wait + 2
    for k in (batches, batches + 1):
        end = spark.range(1, numPartitions=1).select(F.lit(None).cast("long").alias("click_id"), F.lit(past).cast("long").alias("hour"), F.lit(b"").alias("hash"))
        end.select("click_id", "hour", at, "hash").write.parquet(f"{base}/feeds/batch={k}")
    there = {r["batch"] for r in spark.read.parquet(f"{base}/feeds").select("batch").distinct().collect()}  # batches + 2 numbers at most
    for k in set(range(batches)) - there:
        spark.createDataFrame([], event).write.parquet(f"{base}/feeds/batch={k}")
    if keys == 0:
        keys = max(LEAST_KEYS, n // COPIES_A_KEY)
    return deduplicated(spark, base, event, batches, span, wait, zero, keys)


def op11_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = click_windows(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return out.withColumn("hash", F.lower(F.hex("hash")))
