"""Bootstrap intervals against a local bootstrap; merges of complete and broken-off pulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import bootstrap, merge


def exact_area(p, y):
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    ranks = np.empty(len(p))
    for v in np.unique(p):
        at = np.flatnonzero(p == v)
        ranks[at] = at.mean() + 1
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_bootstrap_of_the_area(spark):
    r = np.random.default_rng(3)
    rows = []
    for c in range(60):
        shift = r.normal() * 0.8
        for _ in range(int(r.integers(5, 40))):
            p = 1 / (1 + np.exp(-(r.normal() + shift)))
            rows.append((c, float(p), int(r.random() < p)))
    rows += [(None, 0.5, 1), (1, None, 0)]
    d = spark.createDataFrame(rows, "c int, p double, y int").repartition(5)
    out = {x.measure: x for x in bootstrap.intervals(bootstrap.auc_draws(d, "c", "p", "y", draws=1000)).collect()}
    data = [x for x in rows if None not in x]
    c, p, y = (np.array(v) for v in zip(*data, strict=True))
    assert out["auc"].estimate == pytest.approx(exact_area(p, y), abs=2e-3)
    assert out["brier"].estimate == pytest.approx(float(((p - y) ** 2).mean()))
    local = []
    for _ in range(600):
        pick = r.integers(0, 60, 60)
        at = np.concatenate([np.flatnonzero(c == k) for k in pick])
        local.append((exact_area(p[at], y[at]), ((p[at] - y[at]) ** 2).mean()))
    for k, m in enumerate(("auc", "brier")):
        low, high = np.percentile([v[k] for v in local], [2.5, 97.5])
        width = high - low
        assert abs(out[m].low - low) < 0.15 * width and abs(out[m].high - high) < 0.15 * width
        assert out[m].high - out[m].low == pytest.approx(width, rel=0.2)


def test_draws_don_t_depend_on_partitions(spark):
    d = spark.range(500).select((F.col("id") % 20).alias("c"), ((F.col("id") * 37 % 100) / 100).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    one, many = (sorted(map(tuple, bootstrap.auc_draws(d.repartition(n), "c", "p", "y", draws=50).collect())) for n in (1, 7))
    assert [x[0] for x in one] == list(range(51))
    assert np.allclose(np.array(one), np.array(many))
    only = d.filter("y = 1")
    assert all(r.auc is None for r in bootstrap.auc_draws(only, "c", "p", "y", draws=3).collect())


def test_merge(spark):
    held = spark.createDataFrame([("a", 1, "old", "x.jpg"), ("a", 2, "gone", None), ("b", 3, "old", None), ("z", 9, "stranger", None)], "spot string, id int, text string, photo string")
    pulled = spark.createDataFrame([("a", 1, "new", None), ("a", 4, "added", "y.jpg"), ("q", 7, "stranger", None)], "spot string, id int, text string, photo string")
    known = spark.createDataFrame([("a",), ("b",)], "spot string")
    part = {r.id: tuple(r) for r in merge.merged(held, pulled, ["spot", "id"], False, known, ("photo",)).collect()}
    assert part == {1: ("a", 1, "new", "x.jpg", False), 2: ("a", 2, "gone", None, True), 3: ("b", 3, "old", None, True), 4: ("a", 4, "added", "y.jpg", False)}
    whole = {r.id for r in merge.merged(held, pulled, ["spot", "id"], True, known, ("photo",)).collect()}
    assert whole == {1, 4}
    nothing = pulled.filter("false")
    assert {r.id for r in merge.merged(held, nothing, ["spot", "id"], False).collect()} == {1, 2, 3, 9}  # the service is down: all is held over
    assert merge.merged(held, nothing, ["spot", "id"], True).isEmpty()
