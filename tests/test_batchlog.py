"""Four tables from one batch: crashes, replays, numbers left out, merging."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fluvia.streaming import batchlog, folds

POLL = "site_id int, company string, status int, status_start timestamp, fetched_at timestamp"
T0 = dt.datetime(2024, 5, 1, 9, 10)


def poll(spark, hour, rows):
    return spark.createDataFrame([(s, c, st, start, T0 + dt.timedelta(hours=hour)) for s, c, st, start in rows], POLL)


def state(log, spark):
    order = {"snapshot": ["site_id"], "history": ["site_id", "fetched_at"], "coverage": ["site_id", "day"], "polls": ["batch", "company"]}
    return {name: [tuple(r) for r in log.read(spark, name).orderBy(*by).collect()] for name, by in order.items()}


def polls(spark):
    began = T0 - dt.timedelta(hours=2)
    return [
        poll(spark, 0, [(1, "a", 0, None), (2, "a", 1, began), (3, "b", 0, None)]), poll(spark, 1, [(1, "a", 0, None), (2, "a", 1, began)]),
        poll(spark, 2, [(1, "a", -1, None), (2, "a", 0, None)]), poll(spark, 20, [(1, "a", 0, None), (3, "b", 1, T0)]), poll(spark, 21, [(1, "a", 0, None), (3, "b", 1, T0)]),
    ]


def test_what_the_tables_hold(spark, tmp_path):
    log = folds.live_log(str(tmp_path / "a"))
    for n, p in enumerate(polls(spark)[:3]):
        log(p, n)
    got = state(log, spark)
    assert [(r[0], r[2], r[5]) for r in got["snapshot"]] == [(1, -1, None), (2, 0, None), (3, -3, T0 + dt.timedelta(hours=1))]
    assert [(r[0], r[2], r[4]) for r in got["history"]] == [(1, 0, T0 + dt.timedelta(hours=1)), (1, -1, T0 + dt.timedelta(hours=2)), (2, 1, T0 + dt.timedelta(hours=1)), (2, 0, T0 + dt.timedelta(hours=2)), (3, 0, T0)]
    assert [r[2:] for r in got["coverage"]] == [(3, 2, 1 << 18 | 1 << 20), (3, 3, 1 << 18 | 1 << 20 | 1 << 22), (1, 1, 1 << 18)]
    assert got["polls"] == [(0, "a", 2, 2), (0, "b", 1, 1), (1, "a", 2, 2), (2, "a", 2, 1)]
    log(polls(spark)[3], 3)
    assert [(r[0], r[2], r[5]) for r in state(log, spark)["snapshot"]] == [(1, 0, None), (3, 1, None)]


@pytest.mark.parametrize("merge_after", [1, 2, 16])
def test_crash_between_sinks_replay_and_left_out_numbers(spark, tmp_path, merge_after, monkeypatch):
    numbers = [0, 1, 4, 7, 8]
    good, bad = (folds.live_log(str(tmp_path / x), merge_after) for x in ("good", "bad"))
    for n, p in zip(numbers, polls(spark), strict=True):
        good(p, n)
    for n, p in zip(numbers, polls(spark), strict=True):
        if n in (1, 7):
            before = state(bad, spark)
            plain = bad.tables["coverage"]
            bad.tables["coverage"] = batchlog.Folded(lambda *_: 1 / 0)  # after two tables are written
            with pytest.raises(ZeroDivisionError):
                bad(p, n)
            bad.tables["coverage"] = plain
            assert state(bad, spark) == before  # what was half written is not seen
        bad(p, n)
        bad(p, n)  # replayed
        bad(polls(spark)[0], 0)  # long gone
    assert state(bad, spark) == state(good, spark)
    assert [r[0] for r in state(good, spark)["polls"]] == [0, 0, 1, 4, 7, 7, 8, 8]
    parts = bad.last(spark)["parts"]
    assert all(len(p) <= merge_after + 1 for p in parts.values())
    for name, held in parts.items():  # nothing else stays on disk
        assert set(os.listdir(tmp_path / "bad" / name)) == set(held)


def test_as_a_stream(spark, tmp_path):
    src, log = str(tmp_path / "in"), folds.live_log(str(tmp_path / "log"))
    for p in polls(spark):
        p.coalesce(1).write.mode("append").parquet(src)
        spark.readStream.schema(POLL).parquet(src).writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert log.last(spark)["batch"] == 4 and log.read(spark, "coverage").agg(F.sum("n")).first()[0] == 11
