"""Operators against hand-computed values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import geo, maths, times
from fluvia.operators import graph, models, spatial, temporal
from fluvia.streaming import folds

D = dt.date


def test_span_days_is_capped_and_never_empty(spark):
    x = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 3)), (D(2024, 1, 5), D(2024, 1, 1)), (D(2024, 1, 1), D(2025, 1, 1)), (D(2024, 1, 1), None)], "a date, b date")
    assert [len(r[0]) for r in x.select(times.span_days(F.col("a"), F.col("b"))).collect()] == [3, 1, 61, 1]


def test_decay_index(spark):
    x = spark.createDataFrame([(1, D(2024, 1, 1), 18.0), (1, D(2024, 1, 2), None), (1, D(2024, 1, 3), 1.0)], "k int, d date, v double")
    got = [r.api for r in temporal.decay_index(x, ["k"], "d", "v").orderBy("d").collect()]
    assert [round(v, 6) for v in got] == [18.0, 15.3, round(15.3 * 0.85 + 1, 6)]


def test_travel_shift_splits_over_two_days(spark):
    x = spark.createDataFrame([(1, D(2024, 1, 1), 36.0, 0.5), (1, D(2024, 1, 1), 0.0, 0.2)], "k int, d date, h double, p double")
    got = {r.d: round(r.p, 6) for r in temporal.travel_shift(x, "d", "h", "p", ["k"]).collect()}
    assert got[D(2024, 1, 2)] == 0.25 and got[D(2024, 1, 3)] == 0.25
    assert abs(got[D(2024, 1, 1)] - 0.2) < 1e-9


def test_asof_is_strict_and_valid(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 7, "a"), (1, 8, 20, "b")], "k int, rt int, until int, v string")
    strict = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "rt").collect()}
    assert strict == {(1, 5): None, (1, 10): "b", (2, 3): None}
    valid = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "rt", strict=False, until="until").collect()}
    assert valid == {(1, 5): "a", (1, 10): "b", (2, 3): None}


def test_last_non_null_stitches_rows(spark):
    x = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, None, None)], "k int, t int, a string, b int")
    assert tuple(temporal.last_non_null(x, ["k"], "t", ["a", "b"]).first()) == (1, "a", 5)


def test_closure_keeps_shortest_on_a_braid_and_a_cycle(spark):
    e = spark.createDataFrame([(2, 1, 5.0), (3, 1, 1.0), (2, 3, 1.0), (4, 2, 10.0), (3, 4, 1.0)], "src long, dst long, length double")
    got = {r.node: r.dist for r in graph.closure(e, spark.createDataFrame([(1,)], "node long"), 100.0).collect()}
    assert got == {1: 0.0, 3: 1.0, 2: 2.0, 4: 12.0}


def test_unfinished_rounds_are_an_error(spark):
    chain = [(k + 1, k) for k in range(1, 9)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in chain], "src long, dst long, length double")
    root = spark.createDataFrame([(1,)], "node long")
    for unfinished in (lambda: graph.closure(e, root, 100.0, 3), lambda: graph.min_label(e, 1)):
        with pytest.raises(RuntimeError):
            unfinished()
    assert graph.closure(e, root, 100.0).count() == 9


def test_accumulated_length_with_a_cycle(spark):
    e = [("head", "alpha", 1000.0), ("alpha", "beta", 200.0), ("beta", "gamma", 300.0), ("gamma", "alpha", 400.0), ("gamma", "out", 500.0)]
    for rows in (e, e[::-1]):
        got = {r.node: r.upstream for r in graph.accumulate(spark.createDataFrame(rows, "src string, dst string, length double")).collect()}
        assert got == {"head": 0.0, "alpha": 1000.0, "beta": 1200.0, "gamma": 1500.0, "out": 2000.0}
    two = [(1, 2, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 4, 1.0), (5, 6, 1.0), (1, 6, 10.0)]
    got = {r.node: r.upstream for r in graph.accumulate(spark.createDataFrame(two, "src int, dst int, length double")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 4.0, 6: 15.0}


def test_closure_follows_a_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(k + 1, k, 0.5) for k in range(1, n)], "src long, dst long, length double")
    got = {r.node: r.dist for r in graph.closure(e, spark.createDataFrame([(1,)], "node long"), 1e9).collect()}
    assert got == {k: 0.5 * (k - 1) for k in range(1, n + 1)}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "src long, dst long")
    assert {r.node: r.label for r in graph.min_label(e).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


def test_nearest_equals_brute_force(spark):
    p = [(i, float(i * 37 % 101), float(i * 53 % 89)) for i in range(60)]
    q = [(i, float(i * 71 % 97), float(i * 31 % 83)) for i in range(25)]
    got = {r.a: r.b for r in spatial.nearest_join(spark.createDataFrame(p, "a int, px double, py double"), spark.createDataFrame(q, "b int, qx double, qy double"), "a", "b", 15.0).collect()}
    want = {}
    for a, x, y in p:
        d, b = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, b) for b, u, v in q)
        if d <= 15:
            want[a] = b
    assert got == want


def test_greedy_dedupe(spark):
    x = spark.createDataFrame([(1, 3, 0.0, 0.0), (2, 2, 1.0, 0.0), (3, 1, 2.0, 0.0), (4, 9, 50.0, 0.0)], "k int, rank int, px double, py double")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert sorted(r.k for r in spatial.greedy_dedupe(x, "k", "rank", 1.5).collect()) == [1, 3, 4]


def test_greedy_dedupe_of_a_long_chain(spark):
    x = spark.createDataFrame([(k, 1000 - k, float(k), 0.0) for k in range(60)], "k int, rank int, px double, py double")
    assert sorted(r.k for r in spatial.greedy_dedupe(x, "k", "rank", 1.0).collect()) == list(range(0, 60, 2))


def test_swapped_pairs(spark):
    x = spark.createDataFrame([(52.0, -1.5), (-1.5, 52.0), (10.0, 10.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in x.select(*geo.lat_lon_in_box(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [(52.0, -1.5, False), (52.0, -1.5, True), (None, None, False)] and got[3][:2] == (None, None)


def test_boosted_trees_are_monotone_and_emitted_whole(spark):
    r = np.random.default_rng(3)
    x = r.random((4000, 3))
    y = (r.random(4000) < 1 / (1 + np.exp(-(4 * x[:, 0] + 2 * np.sin(9 * x[:, 0]) - 3 * x[:, 1] - 1)))).astype(float)
    m = models.Monotone(["a", "b", "c"], [1, -1, 0]).fit(x, y, np.ones(4000))
    grid = [(i / 50, j / 4, k / 2) for j in range(5) for k in range(3) for i in range(51)] + [(j / 4, i / 50, k / 2) for j in range(5) for k in range(3) for i in range(51)]
    p = [v[0] for v in spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "i int, a double, b double, c double").orderBy("i").select(m.probability()).collect()]
    for k, sign in enumerate((1, -1)):
        for line in np.array(p).reshape(2, 15, 51)[k]:
            assert (sign * np.diff(line) >= -1e-12).all()
    said = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double").orderBy("i").select(m.probability()).collect()
    order = np.argsort([v[0] for v in said])
    ranks = np.empty(4000)
    ranks[order] = np.arange(4000)
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.75 and 0 < len(m.trees) <= 100
    assert models.Monotone(["a"], [1]).fit(np.zeros((0, 1)), np.zeros(0), np.zeros(0)).trees == []


@pytest.mark.parametrize("k", [0.85, 0.2, 0.9995])
def test_decay_index_of_many_days(spark, k):
    values = np.random.default_rng(2).random(900).tolist()
    x = spark.createDataFrame([(1, i, None if i % 50 == 7 else v) for i, v in enumerate(values)], "key int, day int, rain double")
    got = [r.api for r in temporal.decay_index(x, ["key"], "day", "rain", k).orderBy("day").collect()]
    acc, want = 0.0, []
    for i, v in enumerate(values):
        acc = acc * k + (0.0 if i % 50 == 7 else v)
        want.append(acc)
    assert np.allclose(got, want, rtol=1e-9)


def test_interpolation_is_flat_beyond_its_ends(spark):
    x = spark.createDataFrame([(0.0,), (0.2,), (1.0,)], "p double")
    got = [r[0] for r in x.select(maths.interpolate(F.col("p"), [0.1, 0.3], [0.0, 1.0])).collect()]
    assert [round(v, 6) for v in got] == [0.0, 0.5, 1.0]


def test_fold_replayed_changes_nothing(spark, tmp_path):
    e = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 1, 0, 10)), (2, 7, dt.datetime(2024, 1, 1, 0, 40))], "event_id int, user_id int, ts timestamp")
    fold = folds.CoverageFold(str(tmp_path))
    fold(e, 0)
    fold(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), 1)
    fold(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), 1)
    assert tuple(spark.read.parquet(f"{tmp_path}/v=1").select("n", "slots").first()) == (4, 0b1111)


def test_fold_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 1, 0, 10)), (2, 7, dt.datetime(2024, 1, 1, 0, 40))], "event_id int, user_id int, ts timestamp").write.parquet(str(src))
    q = spark.readStream.schema("event_id int, user_id int, ts timestamp").parquet(str(src)).writeStream.foreachBatch(folds.CoverageFold(str(tmp_path / "state"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/state/v=0").select("n").first()[0] == 2
