"""Grid projection as column expressions (transverse Mercator on the Airy 1830 ellipsoid; no datum shift, so metre-level only)."""

from __future__ import annotations

from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

#: National grid constants. Fixed values.
A, B, F0, LAT0, LON0, E0, N0 = 6377563.396, 6356256.909, 0.9996012717, radians(49), radians(-2), 400000.0, -100000.0


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of a latitude and longitude in degrees (on the grid's own datum)."""
    e2, n = 1 - (B / A) ** 2, (A - B) / (A + B)
    p, q = F.radians(lat), F.radians(lon) - F.lit(LON0)
    s2 = F.pow(F.sin(p), F.lit(2.0))
    nu = F.lit(A * F0) / F.sqrt(1 - e2 * s2)
    rho = F.lit(A * F0 * (1 - e2)) / F.pow(1 - e2 * s2, F.lit(1.5))
    eta2, t2, c = nu / rho - 1, F.pow(F.tan(p), F.lit(2.0)), F.cos(p)
    d, s = p - F.lit(LAT0), p + F.lit(LAT0)
    m = F.lit(B * F0) * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - (35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * s)
    )
    north = m + N0 + nu / 2 * F.sin(p) * c * q * q + nu / 24 * F.sin(p) * F.pow(c, F.lit(3.0)) * (5 - t2 + 9 * eta2) * F.pow(q, F.lit(4.0))
    north = north + nu / 720 * F.sin(p) * F.pow(c, F.lit(5.0)) * (61 - 58 * t2 + t2 * t2) * F.pow(q, F.lit(6.0))
    east = F.lit(E0) + nu * c * q + nu / 6 * F.pow(c, F.lit(3.0)) * (nu / rho - t2) * F.pow(q, F.lit(3.0))
    east = east + nu / 120 * F.pow(c, F.lit(5.0)) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(q, F.lit(5.0))
    return east, north


def _arc(p: Column) -> Column:
    """Length of the meridian from the true origin to latitude p."""
    n = (A - B) / (A + B)
    d, s = p - F.lit(LAT0), p + F.lit(LAT0)
    return F.lit(B * F0) * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - (35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * s)
    )


def from_grid(east: Column, north: Column, steps: int = 5) -> tuple[Column, Column]:
    """Latitude and longitude in degrees (on the grid's own datum) of an easting and northing.

    The latitude with the same arc is found by `steps` corrections, each a few thousand times smaller than the one before.
    """
    goal = north - F.lit(N0)
    first = goal / F.lit(A * F0) + F.lit(LAT0)
    foot = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda p, _: p + (goal - _arc(p)) / F.lit(A * F0))
    # bound in a lambda, so that the steps are not written out at each use
    place = F.get(F.transform(F.array(foot), lambda p: _degrees(p, east - F.lit(E0))), F.lit(0))
    return place["lat"], place["lon"]


def _degrees(p: Column, x: Column) -> Column:
    """Latitude and longitude at a distance x from the central meridian, at whose foot the latitude is p."""
    e2 = 1 - (B / A) ** 2
    s2, t = F.pow(F.sin(p), F.lit(2.0)), F.tan(p)
    nu = F.lit(A * F0) / F.sqrt(1 - e2 * s2)
    rho = F.lit(A * F0 * (1 - e2)) / F.pow(1 - e2 * s2, F.lit(1.5))
    eta2, t2, sec = nu / rho - 1, t * t, 1 / F.cos(p)
    power = lambda c, k: F.pow(c, F.lit(float(k)))
    lat = (
        p - t / (2 * rho * nu) * power(x, 2) + t / (24 * rho * power(nu, 3)) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * power(x, 4)
        - t / (720 * rho * power(nu, 5)) * (61 + 90 * t2 + 45 * t2 * t2) * power(x, 6)
    )
    lon = (
        F.lit(LON0) + sec / nu * x - sec / (6 * power(nu, 3)) * (nu / rho + 2 * t2) * power(x, 3)
        + sec / (120 * power(nu, 5)) * (5 + 28 * t2 + 24 * t2 * t2) * power(x, 5) - sec / (5040 * power(nu, 7)) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * power(t2, 3)) * power(x, 7)
    )
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def to_grid_sql(source: str, key: str) -> str:
    """`to_grid` of (key, lat, lon) in DuckDB's SQL, to a tenth of a metre, with `back` true."""
    e2, n = 1 - (B / A) ** 2, (A - B) / (A + B)
    k = (1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * n**2 + 15 / 8 * n**3, 35 / 24 * n**3)
    return f"""WITH s AS ({source}), r AS (SELECT {key}, radians(lat) AS p, radians(lon) - ({LON0!r}) AS q FROM s),
u AS (SELECT *, {A * F0!r} / sqrt(1 - {e2!r} * pow(sin(p), 2)) AS nu, {A * F0 * (1 - e2)!r} / pow(1 - {e2!r} * pow(sin(p), 2), 1.5) AS rho, pow(tan(p), 2) AS t2, cos(p) AS c, p - {LAT0!r} AS d, p + {LAT0!r} AS sm FROM r),
v AS (SELECT *, nu / rho - 1 AS eta2, {B * F0!r} * ({k[0]!r} * d - {k[1]!r} * sin(d) * cos(sm) + {k[2]!r} * sin(2 * d) * cos(2 * sm) - {k[3]!r} * sin(3 * d) * cos(3 * sm)) AS m FROM u)
SELECT {key}, round({E0!r} + nu * c * q + nu / 6 * pow(c, 3) * (nu / rho - t2) * pow(q, 3) + nu / 120 * pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * pow(q, 5), 1) AS east,
  round(m + {N0!r} + nu / 2 * sin(p) * c * q * q + nu / 24 * sin(p) * pow(c, 3) * (5 - t2 + 9 * eta2) * pow(q, 4) + nu / 720 * sin(p) * pow(c, 5) * (61 - 58 * t2 + t2 * t2) * pow(q, 6), 1) AS north, true AS back FROM v"""


#: The box of plausible places: latitudes and longitudes. Fixed values.
LATITUDES, LONGITUDES = (49.8, 60.95), (-8.7, 1.8)


def lat_lon_in_box(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Latitude and longitude of two numbers in either order, null where neither order lies in the box; and whether they were turned."""
    straight = a.between(*LATITUDES) & b.between(*LONGITUDES)
    turned = ~straight & b.between(*LATITUDES) & a.between(*LONGITUDES)
    return F.when(straight, a).when(turned, b), F.when(straight, b).when(turned, a), turned
