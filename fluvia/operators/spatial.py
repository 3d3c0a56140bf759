"""Joins in the plane by tiles: equi-joins on neighbouring tiles, refined by distance; and points in rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.operators.graph import _step


def with_tile(df: DataFrame, x: str, y: str, size: float, names: tuple[str, str] = ("_tx", "_ty")) -> DataFrame:
    return df.withColumn(names[0], F.floor(F.col(x) / size)).withColumn(names[1], F.floor(F.col(y) / size))


def place_join(points: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Each distinct place (px, py) of `points` with the targets (qx, qy) at most `most` away, and `dist`: a place meets the targets of nine tiles only."""
    a = with_tile(points.select("px", "py").distinct(), "px", "py", most)
    a = a.withColumn("_tx", F.explode(F.array(*[F.col("_tx") + d for d in (-1, 0, 1)]))).withColumn("_ty", F.explode(F.array(*[F.col("_ty") + d for d in (-1, 0, 1)])))
    d = F.sqrt(F.pow(F.col("px") - F.col("qx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("qy"), F.lit(2.0)))
    return a.join(with_tile(targets, "qx", "qy", most), ["_tx", "_ty"]).withColumn("dist", d).filter(F.col("dist") <= most).drop("_tx", "_ty")


#: Points that one task gives their pairs.
POINTS_A_TASK = 1 << 14


def _given(points: DataFrame, met: DataFrame) -> DataFrame:
    """`points` with the rows of `met` for their places (px, py), in tasks whose number grows with them: a place may have many, which no size of either side tells, so none
    is broadcast and no shuffle made smaller. The key is a text, since a join of doubles would deal the points out again."""
    at = F.concat_ws(" ", *[(F.col(c) + F.lit(0.0)).cast("string") for c in ("px", "py")])
    x = points.withColumn("_at", at).repartition(1 + points.count() // POINTS_A_TASK, "_at")
    return x.join(met.withColumn("_at", at).drop("px", "py").hint("merge"), "_at").drop("_at")


def within_join(points: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """All pairs of (px, py) and (qx, qy) at most `most` apart, with `dist`: found by distinct places, then given to the rows that share them."""
    met = place_join(points, targets.select("qx", "qy").distinct(), most)
    return _given(points, met.join(targets, ["qx", "qy"]))


#: Rings that `nearest_join` searches: shares of the farthest distance.
RINGS = (0.125, 0.25, 0.5, 1.0)


def nearest_join(points: DataFrame, targets: DataFrame, point_key: str, target_key: str, most: float) -> DataFrame:
    """The nearest target of each point, ties by key.

    Points of one place share it, and of targets at one place the smallest key goes before the others, so both are searched by distinct places. Outwards in RINGS of
    tiles: a place that has met a target within a ring's distance is done, since any target of a wider ring is farther; so dense places meet small tiles only.
    """
    first = targets.groupBy("qx", "qy").agg(F.min(target_key).alias(target_key))
    found, left = None, points.select("px", "py").distinct()
    for share in RINGS:
        met = place_join(left, first, most * share).groupBy("px", "py").agg(F.min(F.struct("dist", target_key)).alias("_b"))
        best = _step(met)
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("px", "py"), ["px", "py"], "left_anti")
    x = points.select(point_key, "px", "py").join(found, ["px", "py"]).groupBy(point_key).agg(F.min("_b").alias("_b"))
    return x.select(point_key, F.col(f"_b.{target_key}").alias(target_key), F.col("_b.dist").alias("dist"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and the fraction along it of the nearest place."""
    length2 = F.pow(bx - ax, F.lit(2.0)) + F.pow(by - ay, F.lit(2.0))
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - ax - t * (bx - ax), F.lit(2.0)) + F.pow(py - ay - t * (by - ay), F.lit(2.0))), t


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges crossed."""
    n = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            n = n + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - F.lit(ay)) / F.lit(by - ay) + F.lit(ax))).cast("int")
    return n % 2 == 1


def in_ring_of(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting against a ring that is data: an array of structs (x, y)."""
    n = F.size(ring)
    at = lambda i: F.get(ring, F.pmod(i, n))

    def crossed(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        return F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crossed(i)) % 2 == 1


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the edges of a ring that is data."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return segment_distance(x, y, a["x"], a["y"], b["x"], b["y"])[0]

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge))


def ring_join(points: DataFrame, rings: DataFrame, size: float, shore: float) -> DataFrame:
    """Points (px, py) with the rings (ring: array of structs x, y) that hold them or whose shore is at most `shore` away, with `inside` and
    `to_shore`: by the tiles of side `size` that a ring's box, widened by `shore`, covers. Distinct places meet distinct rings; rows that share them get the result."""
    lo = lambda c: F.floor((F.array_min(F.transform("ring", lambda p: p[c])) - shore) / size)
    hi = lambda c: F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + shore) / size)
    tiles = rings.select("ring").distinct().withColumn("_tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_ty", F.explode(F.sequence(lo("y"), hi("y"))))
    met = with_tile(points.select("px", "py").distinct(), "px", "py", size).join(tiles, ["_tx", "_ty"]).drop("_tx", "_ty")
    met = met.withColumn("inside", in_ring_of(F.col("px"), F.col("py"), F.col("ring"))).withColumn("to_shore", ring_distance(F.col("px"), F.col("py"), F.col("ring")))
    met = met.filter(F.col("inside") | (F.col("to_shore") <= shore))
    return _given(points, met.join(rings, "ring"))


def _best_of_places(df: DataFrame, key: str, rank: str) -> DataFrame:
    """The best-ranked row of each place, ties by key. Rows without a place or rank, which neither suppress nor are suppressed, stay."""
    whole = F.col("px").isNotNull() & F.col("py").isNotNull() & F.col(rank).isNotNull()
    x = df.filter(whole)
    top = x.join(x.groupBy("px", "py").agg(F.max(rank).alias(rank)), ["px", "py", rank], "left_semi")
    first = top.groupBy("px", "py", rank).agg(F.min(key).alias(key))
    return x.join(first, ["px", "py", rank, key], "left_semi").unionByName(df.filter(~whole))


def greedy_dedupe(df: DataFrame, key: str, rank: str, most: float) -> DataFrame:
    """Keep the best-ranked point (px, py) of those within `most`, in the order (rank desc, key): rounds of suppression, until none is open.

    Of the points at one place only the best can be kept: what suppresses it lies as near to the others. Each of these meets its neighbours once; in each round, a
    point with no better open neighbour is kept and closes its neighbours. A chain in which each point is just better than the next takes as many rounds as it has kept points.
    """
    near = lambda c: F.col(c)
    df = _step(_best_of_places(df, key, rank))
    q = df.select(F.col(key).alias("_k"), F.col(rank).alias("_r"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    better = (near("_r") > near(rank)) | ((near("_r") == near(rank)) & (near("_k") < near(key)))
    links = _step(within_join(df, q, most).filter(better).select(F.col(key).alias("worse"), F.col("_k").alias("better")))
    closed = None
    while not links.isEmpty():
        # the best of those that still have links: nobody open is better
        best = links.select(F.col("better").alias("node")).distinct().join(links.select(F.col("worse").alias("node")), "node", "left_anti")
        gone = _step(links.join(best, links.better == best.node, "left_semi").select(F.col("worse").alias("node")).distinct())
        closed = gone if closed is None else closed.unionByName(gone)
        done = best.unionByName(gone).distinct()
        left = links.join(done, links.worse == done.node, "left_anti")
        links = _step(left.join(gone, left.better == gone.node, "left_anti"))
    return df if closed is None else df.join(closed, F.col(key) == closed.node, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def polygon_edges(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """key, ax, ay, bx, by of polygons whose `rings` (arrays of x, y; outer rings of all parts and holes alike) close by themselves or not."""
    ring = polygons.select(key, F.explode(rings).alias("_ring")).filter("size(_ring) > 2")
    x = ring.select(key, "_ring", F.posexplode("_ring").alias("_i", "_a"))
    b = F.get("_ring", (F.col("_i") + 1) % F.size("_ring"))
    x = x.select(key, F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return x.filter("ax <> bx OR ay <> by")


def polygon_join(points: DataFrame, polygons: DataFrame, point: str, polygon: str, size: float, shore: float, rings: str = "rings") -> DataFrame:
    """point, polygon, inside, to_shore of the points (point, px, py) in a polygon (polygon, rings) or within `shore` of its outline; to_shore is null beyond.

    A point is inside where a ray to the right crosses the outlines an odd number of times, all rings counted, so holes and parts need no case of their own. Edges are
    filed by strips of height `size`, and for the distance by the tiles that they come near: a point meets the edges of its strip and tile, not a lake of many
    corners whole. Pairs to test come from the tiles of the polygons' boxes. One point stands for all of its place and one polygon for all with its very rings; the
    others get their results.
    """
    tile = lambda c: F.floor(F.col(c) / size)
    places = points.groupBy("px", "py").agg(F.min(point).alias(point))
    pts = places.select(point, "px", "py", tile("px").alias("_tx"), tile("py").alias("_ty"))
    shapes = polygons.groupBy(rings).agg(F.min(polygon).alias(polygon))
    e = polygon_edges(shapes, polygon, rings)
    lo = {c: F.least(f"a{c}", f"b{c}") for c in "xy"}
    hi = {c: F.greatest(f"a{c}", f"b{c}") for c in "xy"}
    box = e.groupBy(polygon).agg(*[F.floor(f(v[c]) / size).alias(f"{n}{c}") for n, f, v in (("l", F.min, lo), ("h", F.max, hi)) for c in "xy"])
    box = box.select(polygon, F.explode(F.sequence("lx", "hx")).alias("_tx"), "ly", "hy").select(polygon, "_tx", F.explode(F.sequence("ly", "hy")).alias("_ty"))
    pairs = pts.join(box, ["_tx", "_ty"])
    strips = e.select("*", F.explode(F.sequence(F.floor(lo["y"] / size), F.floor(hi["y"] / size))).alias("_ty"))
    at = F.col("ax") + (F.col("bx") - F.col("ax")) * F.try_divide(F.col("py") - F.col("ay"), F.col("by") - F.col("ay"))
    crossed = pairs.join(strips, [polygon, "_ty"]).filter(((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (F.col("px") < at))
    inside = crossed.groupBy(point, polygon).agg((F.count("*") % 2 == 1).alias("inside")).filter("inside")
    span = lambda c: F.sequence(F.floor((lo[c] - shore) / size), F.floor((hi[c] + shore) / size))
    tiles = e.select("*", F.explode(span("x")).alias("_tx")).select("*", F.explode(span("y")).alias("_ty"))
    away = segment_distance(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))[0]
    near = pts.join(tiles, ["_tx", "_ty"]).select(point, polygon, away.alias("d")).filter(F.col("d") <= shore).groupBy(point, polygon).agg(F.min("d").alias("to_shore"))
    met = inside.join(near, [point, polygon], "full").select(point, polygon, F.coalesce("inside", F.lit(False)).alias("inside"), "to_shore")
    same = polygons.select(rings, F.col(polygon).alias("_same")).join(shapes, rings).select(polygon, "_same")
    met = met.join(places, point).join(same, polygon).select("px", "py", F.col("_same").alias(polygon), "inside", "to_shore")
    return _given(points.select(point, "px", "py"), met).select(point, polygon, "inside", "to_shore")
