"""Intervals, lead-aware shifts and held-out fits against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import intervals, regression, temporal


def interval_rows():
    r = np.random.default_rng(1)
    events = [(int(r.integers(0, 3)), float(s), float(s + r.choice([0, 0.5, 3, 40, 900]))) for s in r.integers(0, 500, 200)]
    windows = [(k, int(r.integers(0, 4)), float(lo), float(lo + r.choice([0, 5, 48]))) for k, lo in enumerate(r.integers(-20, 900, 150))]
    return windows + [(900, None, 1.0, 2.0), (901, 0, None, None)], events + [(0, None, 5.0), (None, 1.0, 2.0), (1, 9.0, 3.0)]


@pytest.mark.parametrize("width", [2.0, 24.0, 5000.0])
def test_overlap_join(spark, width):
    windows, events = interval_rows()
    a = spark.createDataFrame(windows, "w long, k int, lo double, hi double")
    b = spark.createDataFrame([(n, *e) for n, e in enumerate(events)], "e long, k int, s double, t double")
    got = sorted((r.w, r.e) for r in intervals.overlap_join(a, b, ["k"], "lo", "hi", "s", "t", width).collect())
    known = lambda *v: all(x is not None for x in v)
    want = sorted((w, n) for w, k, lo, hi in windows for n, (j, s, t) in enumerate(events) if known(k, lo, hi, j, s, t) and k == j and lo <= hi and s <= t and s <= hi and t >= lo)
    assert got == want and len(want) > 300


@pytest.mark.parametrize("block", [7.0, 100.0, 1e6])
def test_latest_end(spark, block):
    windows, events = interval_rows()
    events = [e for e in events if e != (1, 9.0, 3.0)]
    a = spark.createDataFrame(windows[:-2], "w long, k int, lo double, hi double")
    b = spark.createDataFrame(events, "k int, s double, t double")
    got = {r.w: r["last"] for r in intervals.latest_end(a, b, ["k"], "lo", "hi", "s", "t", block).collect()}
    want = {w: max((t for j, s, t in events if j == k and s is not None and s <= hi and t >= lo), default=None) for w, k, lo, hi in windows[:-2]}
    assert got == want and any(v is None for v in want.values())


def test_latest_end_of_one_hot_key(spark):
    """All rows of one key: the sort falls into as many pieces as there are blocks."""
    a = spark.range(5000).select(F.col("id").alias("w"), F.lit(1).alias("k"), (F.col("id") - 5.0).alias("lo"), F.col("id").cast("double").alias("hi"))
    b = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("s"), (F.col("id") + F.col("id") % 3).cast("double").alias("t"))
    x = intervals.latest_end(a, b, ["k"], "lo", "hi", "s", "t", 100.0)
    assert {r.w: r["last"] for r in x.collect()} == {i: float(max(j + j % 3 for j in range(max(0, i - 2), i + 1))) for i in range(5000)}


@pytest.mark.parametrize("k", [0, 1, 3])
def test_lead_shift(spark, k):
    """Against the matrix form: a source's spill on day S, known at lead max(k - (T - S), 0), in parts on two days."""
    r = np.random.default_rng(4)
    n, days, leads = 5, 12, 4
    p = r.random((leads, n, days))
    gone = r.random((leads, n, days)) < 0.2
    weight, travel = r.random(n), np.array([0.0, 12.0, 24.0, 30.0, 61.0])
    first = dt.date(2024, 1, 1)
    values = spark.createDataFrame([(i, first + dt.timedelta(d), m, None if gone[m, i, d] else float(p[m, i, d])) for m in range(leads) for i in range(n) for d in range(days)], "site int, day date, lead int, p double")
    sources = spark.createDataFrame([(7, i, float(weight[i]), float(travel[i])) for i in range(n)], "root int, site int, weight double, travel_h double")
    got = {r.day: (r.exposure, r.missing) for r in temporal.lead_shift(sources, values, k).collect()}
    for target in range(days):
        eff, lost = np.zeros(n), np.zeros(n)
        for i in range(n):
            whole, part = int(travel[i] // 24), travel[i] / 24 - travel[i] // 24
            for late, share in ((whole, 1 - part), (whole + 1, part)):
                s = target - late
                if s >= 0 and share:
                    m = max(k - late, 0)
                    eff[i] += share * (0 if gone[m, i, s] else p[m, i, s])
                    lost[i] += share * gone[m, i, s]
        want = (1 - np.prod(1 - np.clip(eff, 0, 1) * weight), float(np.clip((lost * weight).sum() / weight.sum(), 0, 1)))
        assert got[first + dt.timedelta(target)] == pytest.approx(want)


def test_leave_one_out_equals_refitting(spark):
    r = np.random.default_rng(9)
    rows = []
    for k in range(400):
        site, year = int(r.integers(0, 12)), 2018 + int(r.integers(0, 4))
        x1, x2 = float(r.normal()), float(r.normal())
        rows.append((k, site, year, x1, x2, 2 * x1 - x2 + site + float(r.normal()) * 0.1))
    rows += [(500 + k, 77, 2019, 1.0 * k, 0.0, 1.0) for k in range(3)] + [(600, 1, None, 1.0, 1.0, 1.0), (601, 1, 2019, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id long, site int, year int, x1 double, x2 double, y double")
    fits, out = regression.leave_one_out(d, "site", "year", ["x1", "x2"], "y")
    fits = {f.year: f for f in fits.collect()}
    out = {o.id: o for o in out.collect()}
    data = [x for x in rows if None not in x]
    assert set(out) == {x[0] for x in data} and set(fits) == {2018, 2019, 2020, 2021}
    for year in fits:
        train = [x for x in data if x[2] != year]
        mean = {s: np.mean([x[3:] for x in train if x[1] == s], axis=0) for s in {x[1] for x in train}}
        z = np.array([np.array(x[3:]) - mean[x[1]] for x in train])
        beta = np.linalg.lstsq(z[:, :2], z[:, 2], rcond=None)[0]
        assert (fits[year].n, fits[year].b_x1, fits[year].b_x2) == (len(train), pytest.approx(beta[0]), pytest.approx(beta[1]))
        for x in data:
            if x[2] == year:
                o = out[x[0]]
                if x[1] in mean:
                    want = float((np.array(x[3:5]) - mean[x[1]][:2]) @ beta)
                    assert (o.within, o.level) == (pytest.approx(want), pytest.approx(want + mean[x[1]][2]))
                else:
                    assert o.within is None and o.level is None
    few, none = regression.leave_one_out(d, "site", "year", ["x1"], "y", least=10_000)
    assert few.isEmpty() and none.filter("level IS NOT NULL").isEmpty()
    assert math.isclose(fits[2018].b_x1, 2, abs_tol=0.05)


@pytest.mark.parametrize("block", [7, 100, 1_000_000])
def test_overlap_totals(spark, block):
    windows, events = interval_rows()
    windows = [(w % 90 if w < 900 else w, k, None if lo is None else int(lo), None if hi is None else int(hi), 1) for w, k, lo, hi in windows]
    events = [(k, *(None if v is None else math.floor(v) for v in (s, t))) for k, s, t in events]
    a = spark.createDataFrame(windows, "w long, k int, lo long, hi long, one int")
    b = spark.createDataFrame(events, "k int, s long, t long")
    got = {r.w: (r.n, int(r.total), r.one) for r in intervals.overlap_totals(a, b, ["k"], ["w"], "lo", "hi", "s", "t", block).collect()}
    want = {}
    for w, k, lo, hi, _ in windows:
        if None not in (k, lo, hi):
            met = [(s, t) for j, s, t in events if j == k and s is not None and t is not None and s <= t and s <= hi and t >= lo]
            n, total, one = want.get(w, (0, 0, 0))
            want[w] = (n + len(met), total + sum(min(t, hi) - max(s, lo) for s, t in met), one + 1)
    want = {w: v for w, v in want.items() if w in got or v[0]}
    assert got == want and sum(v[0] for v in want.values()) > 300
