"""State that is kept up: retraced networks and alerts."""

import os

import numpy as np
from pyspark.sql import functions as F

from fluvia.operators import retrace
from fluvia.streaming import alerts

EDGES = [(k, k // 2, float(1 + k % 5)) for k in range(2, 200)]


def files(path):
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.startswith("part")) for d in os.listdir(path) if d.startswith("tile=")}


def test_retrace_equals_a_full_rebuild_and_leaves_other_files(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, "src long, dst long, length double")
    roots = spark.createDataFrame([(k,) for k in range(1, 120)], "node long")
    old_rows = [(100 + k, 3 * k + 4) for k in range(40)]
    old = spark.createDataFrame(old_rows, "source long, node long")
    path, tile = str(tmp_path / "t"), F.floor(F.col("root") / 8)
    retrace.build(edges, roots, old, 9.0, path, tile)
    before = files(path)
    new_rows = [(s, 190 if s == 105 else n) for s, n in old_rows if s != 111] + [(500, 33)]  # one moved, one gone, one new
    new = spark.createDataFrame(new_rows, "source long, node long")
    redo = {r.node for r in retrace.retrace(edges, roots, old, new, 9.0, path, tile).collect()}
    assert 0 < len(redo) < 119
    want = sorted(map(tuple, retrace.traced(edges, roots, new, 9.0).filter("source IS NOT NULL").collect()))
    assert sorted(map(tuple, retrace.table(spark, path).collect())) == want
    after = files(path)
    touched = {f"tile={k // 8}" for k in redo}
    assert set(before) == set(after)
    assert all((before[t] == after[t]) == (t not in touched) for t in before)
    assert retrace.retrace(edges, roots, new, new, 9.0, path, tile).isEmpty() and files(path) == after


def test_retrace_of_a_root_that_loses_all_sources(spark, tmp_path):
    edges = spark.createDataFrame(EDGES[:20], "src long, dst long, length double")
    roots = spark.createDataFrame([(1,), (9,)], "node long")
    old, none = spark.createDataFrame([(7, 9)], "source long, node long"), spark.createDataFrame([], "source long, node long")
    path = str(tmp_path / "t")
    retrace.build(edges, roots, old, 50.0, path, F.col("root"))
    retrace.retrace(edges, roots, old, none, 50.0, path, F.col("root"))
    assert retrace.table(spark, path).isEmpty()
    retrace.retrace(edges, roots, none, old, 50.0, path, F.col("root"))
    assert sorted(r.root for r in retrace.table(spark, path).collect()) == [1, 9]


def levels():
    r = np.random.default_rng(5)
    rows = [(int(k), int(at) * 600_000, n, None if v > 97 else float(v)) for n, (k, at, v) in enumerate(zip(r.integers(0, 6, 2000), np.sort(r.integers(0, 3000, 2000)), r.integers(0, 100, 2000), strict=True))]
    return rows


def brute_alerts(rows, high=80.0, quiet=20 * 3_600_000):
    last, sent, out = {}, {}, []
    for k, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(k, "first")
        if before not in ("first", None) and v is not None and before < high <= v and (k not in sent or at - sent[k] >= quiet):
            sent[k] = at
            out.append((k, at, i, v))
        last[k] = v
    return sorted(out)


SCHEMA = "key long, at long, id long, level double"


def test_alerts_of_a_table_and_of_a_stream_agree(spark, tmp_path):
    rows = levels()
    want = brute_alerts(rows)
    assert sorted(map(tuple, alerts.alerts(spark.createDataFrame(rows, SCHEMA).repartition(5), 80.0).collect())) == want and len(want) > 30
    src, box = str(tmp_path / "in"), alerts.Outbox(str(tmp_path / "box"))
    cuts = [0, *(k for k in (500, 501, 1300)), 2000]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        while a and b < 2000 and rows[a][1] == rows[a - 1][1]:  # a feed ends between two times
            a += 1
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = alerts.alert_stream(spark.readStream.schema(SCHEMA).parquet(src), 80.0)
        stream.writeStream.foreachBatch(box).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, box.pending(spark, SCHEMA).select("key", "at", "id", "level").collect()))
    fed = [r for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for r in rows[a:b]]
    assert got == brute_alerts(fed)
    assert not {k for k, at, i, v in rows if (k, at, i, v) in got} - {r[0] for r in rows}


def test_first_run_is_silent_and_a_retry_sends_nothing_twice(spark, tmp_path):
    hour = 3_600_000
    first = [(1, 0, 1, 95.0), (2, 0, 2, 10.0)]
    assert alerts.alerts(spark.createDataFrame(first, SCHEMA), 80.0).isEmpty()
    rows = [*first, (2, hour, 3, 90.0), (2, 2 * hour, 4, 10.0), (2, 3 * hour, 5, 90.0), (2, 20 * hour, 6, 10.0), (2, 21 * hour, 7, 85.0)]
    out = alerts.alerts(spark.createDataFrame(rows, SCHEMA), 80.0)
    assert sorted(r.id for r in out.collect()) == [3, 7]  # the rise at 3 h is quiet; 21 h is 20 h after the alert that was sent
    box = alerts.Outbox(str(tmp_path / "box"))
    box(out, 0)
    box(out, 0)  # replayed
    assert box.drain(spark, SCHEMA, lambda r: r["id"] != 7) == 1  # one is not taken
    assert [r.id for r in box.pending(spark, SCHEMA).collect()] == [7]
    assert box.drain(spark, SCHEMA, lambda r: True) == 1 and box.drain(spark, SCHEMA, lambda r: True) == 0
    box(out, 1)  # the same alerts in another batch
    assert box.pending(spark, SCHEMA).isEmpty()
    assert box.pending(spark, SCHEMA, after=10**12).isEmpty()
