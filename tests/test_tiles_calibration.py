"""The tile store's round trip and what its reader opens; isotonic and Platt fits against local ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import calibration
from fluvia.sinks import tiles


def test_tile_store(spark, tmp_path):
    r = np.random.default_rng(2)
    links = [(k, float(r.uniform(-50, 400)), float(r.uniform(-50, 400)), float(k)) for k in range(300)] + [(900, 100.0, 200.0, 1.0), (901, 200.0, 200.0, 1.0)]
    records = [(k, int(s), float(10 * r.integers(0, 900)), float(r.integers(0, 10_001)) / 10_000) for k, *_ in links for s in r.choice(5000, r.integers(0, 6), replace=False)]
    path = str(tmp_path)
    a, b = spark.createDataFrame(links, "link long, x double, y double, upstream double"), spark.createDataFrame(records, "link long, source int, base double, share double")
    tiles.write(a, b, path, 100.0)
    box = (-20.0, 100.0, 200.0, 230.0)
    inside = {k for k, x, y, _ in links if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {r.link: (r.x, r.y, r.upstream) for r in tiles.links_in(spark, path, 100.0, box).collect()} == {k: (x, y, u) for k, x, y, u in links if k in inside}
    got = tiles.records_in(spark, path, 100.0, box)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in records if r[0] in inside)
    everything = (-100.0, -100.0, 500.0, 500.0)
    assert sorted(map(tuple, tiles.records_in(spark, path, 100.0, everything).collect())) == sorted(records)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(tx") > 1
    assert tiles._of_box(spark, f"{path}/records", 100.0, box).select("tx", "ty").distinct().filter("tx < -1 OR tx > 2 OR ty < 1 OR ty > 2").isEmpty()


def pav(x, y):
    """Values of the non-decreasing fit at the distinct x."""
    blocks = []
    for v in sorted(set(x)):
        own = [b for a, b in zip(x, y, strict=True) if a == v]
        blocks.append([[v], sum(own), len(own)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            vs, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + vs, blocks[-1][1] + s, blocks[-1][2] + n]
    return {v: s / n for vs, s, n in blocks for v in vs}


def calibration_rows():
    r = np.random.default_rng(7)
    rows = []
    for g, n in (("a", 3000), ("b", 40), ("c", 1)):
        x = np.round(r.random(n), 3)
        rows += [(g, float(v), int(r.random() < v**2)) for v in x]
    return rows + [("a", None, 1), ("b", 0.5, None)]


def test_isotonic_equals_a_local_fit(spark):
    rows = calibration_rows()
    d = spark.createDataFrame(rows, "g string, x double, y int").repartition(6)
    blocks = calibration.isotonic(d, "g", "x", "y")
    for g in "abc":
        own = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        want = pav([x for x, _ in own], [y for _, y in own])
        got = {v: b["mean"] for b in blocks.filter(F.col("grp") == g).collect() for v in want if b["lo"] <= v <= b["hi"]}
        assert got == pytest.approx(want)
    table = calibration.knots(blocks)
    ask = spark.createDataFrame([(g, x) for g in ("a", "b", "c", "none") for x in (-1.0, 0.0, 0.1234, 0.5, 0.77771, 1.0, 9.0)] + [("a", None)], "g string, x double")
    out = {(r.g, r.x): r.p for r in calibration.calibrated(ask, "g", "x", table).collect()}
    ends = {g: sorted((r.x, r.y) for r in table.filter(F.col("grp") == g).collect()) for g in "abc"}
    for (g, x), p in out.items():
        if g == "none" or x is None:
            assert p is None
        else:
            assert p == pytest.approx(float(np.interp(x, [k[0] for k in ends[g]], [k[1] for k in ends[g]])))
    assert len(out) == 29


def test_platt(spark):
    r = np.random.default_rng(1)
    rows = []
    for g, a, b in (("u", 2.0, -0.5), ("v", 0.5, 1.0)):
        for x in r.normal(size=4000):
            rows.append((g, round(float(x), 2), int(r.random() < 1 / (1 + math.exp(-(a * x + b))))))
    got = {r.grp: (r.a, r.b) for r in calibration.platt(spark.createDataFrame(rows, "g string, x double, y int"), "g", "x", "y").collect()}
    for g in "uv":
        x, y = np.array([v for k, v, _ in rows if k == g]), np.array([v for k, _, v in rows if k == g])
        a = b = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            h = np.array([[(p * (1 - p) * x * x).sum(), (p * (1 - p) * x).sum()], [(p * (1 - p) * x).sum(), (p * (1 - p)).sum()]])
            step = np.linalg.solve(h, [((y - p) * x).sum(), (y - p).sum()])
            a, b = a + step[0], b + step[1]
        assert got[g] == pytest.approx((a, b), abs=1e-4)
