"""Polygons with holes and parts against a plain ray cast."""

import math

import numpy as np
import pytest

from fluvia.operators import spatial


def crossings(px, py, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > py) != (by > py) and px < ax + (bx - ax) * (py - ay) / (by - ay):
                n += 1
    return n % 2 == 1


def outline(px, py, rings):
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)) if size else 0.0
            best = min(best, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
    return best


@pytest.mark.parametrize("size", [3.0, 40.0])
def test_polygon_join(spark, size):
    r = np.random.default_rng(4)
    star = lambda x, y, a, n: [(x + a * (1 + 0.4 * math.sin(5 * k)) * math.cos(2 * math.pi * k / n), y + a * (1 + 0.4 * math.sin(5 * k)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    lakes = {1: [star(30, 30, 20, 60), star(30, 30, 8, 12)], 2: [star(80, 20, 9, 7), star(75, 60, 6, 5)], 3: [[(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0), (-5.0, -5.0)]], 4: [[(1.0, 1.0), (2.0, 2.0)]]}
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-15, 100, (600, 2)))] + [(900, 30.0, 30.0)]
    a = spark.createDataFrame(points, "p int, px double, py double")
    b = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in v]) for k, v in lakes.items()], "g int, rings array<array<struct<x double, y double>>>")
    got = {(x.p, x.g): (x.inside, None if x.to_shore is None else round(x.to_shore, 6)) for x in spatial.polygon_join(a, b, "p", "g", size, 4.0).collect()}
    want = {}
    for k, x, y in points:
        for g, rings in lakes.items():
            rings = [q for q in rings if len(q) > 2]
            inside, away = crossings(x, y, rings), outline(x, y, rings)
            if inside or away <= 4:
                want[k, g] = (inside, round(away, 6) if away <= 4 else None)
    assert got == want and (900, 1) not in {k for k, v in got.items() if v[0]} and len(want) > 100
