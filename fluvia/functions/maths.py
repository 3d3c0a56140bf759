"""Scores, weights, distances and interpolation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

T90_H, L0_M, RECENT_H = 30.0, 5000.0, 48.0


def r6(c: Column) -> Column:
    """Six decimals, nudged off ties so that sums in another order round alike."""
    return F.round(c + F.lit(1e-9), 6)


def grid_key(x: Column, step: float = 0.1) -> Column:
    """Cell number on a grid, half to even."""
    return F.rint(x / F.lit(step)).cast("long")


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def decay(hours: Column, t90: float = T90_H) -> Column:
    return F.pow(F.lit(10.0), -hours / F.lit(t90))


def dilution(upstream: Column, spot: Column, l0: float = L0_M) -> Column:
    return F.least(F.lit(1.0), (upstream + F.lit(l0)) / (spot + F.lit(l0)))


def velocity(index: Column, default: float = 0.5) -> Column:
    return F.when(index.isNull(), F.lit(default)).otherwise(F.lit(0.3) + F.lit(0.7) * clip(index, 0.0, 1.5))


def recency(discharging: Column, hours_since: Column, window: float = RECENT_H) -> Column:
    return F.when(discharging, F.lit(1.0)).when(hours_since.between(0.0, window), F.lit(1.0) - hours_since / F.lit(window)).otherwise(F.lit(0.0))


def risk_label(r: Column) -> Column:
    return F.when(r < 0.15, "low").when(r < 0.40, "moderate").when(r < 0.70, "high").otherwise("very high")


def level_index(level: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (level - low) / (high - low))


def level_word(i: Column) -> Column:
    return F.when(i.isNull(), None).when(i < 0.15, "low").when(i < 0.6, "normal").when(i <= 1.0, "raised").otherwise("high")


def interpolate(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear on knots, flat beyond the ends."""
    out = F.when(p <= xs[0], F.lit(ys[0]))
    for a, b, u, v in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(p <= b, F.lit(u) + (p - F.lit(a)) * F.lit((v - u) / (b - a)))
    return out.otherwise(F.lit(ys[-1]))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(12742.0) * F.asin(F.sqrt(a))


def noisy_or(x: Column) -> Column:
    """Aggregate: 1 - product of (1 - x)."""
    return F.lit(1.0) - F.product(F.lit(1.0) - x)
