"""Approximate nearest neighbours by vantage-point trees, one for each piece of a shard.

Vectors go to the shard of their nearest pivot, shards are cut by ranges into pieces of about ROWS vectors, however many vectors one pivot draws, and each piece is one
tree: its nodes hold a vantage point and the least and greatest distance from it of each half. A query visits the trees of its own shard first; the distance
that it then has to beat rules out other shards by the triangle inequality (distance to the pivot less the shard's radius), and within a tree halves. Bounds
are relaxed by `factor`: what can't come nearer than `factor` times the distance to beat is passed over, so one is exact search and less trades
recall for speed.

Equal vectors are indexed once with their k + 1 smallest ids, which are all that a result of k can hold, and equal queries are searched once, so a vector that a third of
all rows share is one vector. Distances are computed on the original components in double precision; products of matrices only choose
which ones to compute.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; of rows that share an
id, the one with the least vector counts; vectors of another length are no candidates; ties go to smaller ids; with fewer candidates than k all are returned;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvia.llm import common

#: Vectors of a tree, about, and of a leaf.
ROWS, LEAF = 8192, 64
#: The most pivots, which are broadcast: a sample of the vectors, the only thing that is fitted. Their bytes are bounded too.
MOST_PIVOTS, PIVOT_BYTES = 256, 8 << 20
#: Queries that meet a tree at once, about.
QUERIES = 8192
#: Bounds are lowered by this share, more than distances are rounded by.
SLACK = 1e-9


# --- trees -------------------------------------------------------------------------------------------------------


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision, the same wherever a row stands."""
    return np.sqrt(((x.astype(np.float64) - q) ** 2).sum(axis=-1))


class Tree:
    """A balanced vantage-point tree. Leaves hold the points, in `order`; a vantage point is one of its node's points."""

    FIELDS = ("points", "order", "vantage", "bounds", "children", "ranges")

    def __init__(self, points: np.ndarray, order: np.ndarray, vantage: np.ndarray, bounds: np.ndarray, children: np.ndarray, ranges: np.ndarray):
        self.points, self.order, self.vantage, self.bounds, self.children, self.ranges = points, order, vantage, bounds, children, ranges
        self.wide = points.astype(np.float64)
        self.squares = (self.wide**2).sum(axis=1)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n = len(points)
        order = np.arange(n)
        far = distances(points, points.astype(np.float64).mean(axis=0))
        vantage, bounds, children, ranges = [], [], [], []
        todo = [(0, n, -1, 0)]  # begin, end, parent, side
        while todo:
            begin, end, parent, side = todo.pop()
            node = len(vantage)
            if parent >= 0:
                children[parent][side] = node
            own = order[begin:end]
            v = own[np.argmax(far[own])]  # a point at the rim, as seen from the node above
            vantage.append(v)
            bounds.append([0.0, np.inf, 0.0, np.inf])
            children.append([-1, -1])
            ranges.append([begin, end])
            if end - begin <= leaf:
                continue
            d = distances(points[own], points[v].astype(np.float64))
            by = np.argsort(d, kind="stable")
            order[begin:end], d = own[by], d[by]
            far[order[begin:end]] = d
            middle = (end - begin) // 2
            bounds[node] = [d[0], d[middle - 1], d[middle], d[-1]]
            todo += [(begin + middle, end, node, 1), (begin, begin + middle, node, 0)]
        return cls(points, order, np.array(vantage), np.array(bounds), np.array(children), np.array(ranges))

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{k: getattr(self, k) for k in self.FIELDS})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        with np.load(io.BytesIO(blob)) as f:
            return cls(*(f[k] for k in cls.FIELDS))

    def search(self, q: np.ndarray, reach: np.ndarray, k: int, factor: float, first_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances and numbers of the k nearest points of each row of `q` among those no farther than `reach`, ties by `first_ids` (missing: inf and -1),
        and how many distances between queries and points were weighed."""
        m = len(q)
        q = np.ascontiguousarray(q, dtype=np.float64)
        squares = (q**2).sum(axis=1)
        near = np.full((m, k), np.inf)
        which = np.full((m, k), -1)
        ids = np.full((m, k), np.iinfo(np.int64).max)
        reach = reach.astype(np.float64).copy()
        weighed = 0

        def meet(node: int, rows: np.ndarray) -> None:
            nonlocal weighed
            begin, end = self.ranges[node]
            own = self.order[begin:end]
            weighed += len(rows) * len(own)
            size = squares[rows, None] + self.squares[own]
            rough = size - 2 * (q[rows] @ self.wide[own].T)
            i, j = np.nonzero(rough <= reach[rows, None] ** 2 + SLACK * (size + 1))
            if not len(i):
                return
            d = distances(self.points[own[j]], q[rows[i]])
            hit, at = np.unique(i, return_inverse=True)
            slot = np.arange(len(i)) - np.searchsorted(i, i)  # the how-manieth of its query
            wide = int(slot.max()) + 1
            rows = rows[hit]
            all_d, all_w, all_i = (np.concatenate([old[rows], np.full((len(rows), wide), fill)], axis=1) for old, fill in ((near, np.inf), (which, -1), (ids, np.iinfo(np.int64).max)))
            all_d[at, k + slot], all_w[at, k + slot], all_i[at, k + slot] = d, own[j], first_ids[own[j]]
            by = np.lexsort((all_i, all_d), axis=-1)[:, :k]
            near[rows], which[rows], ids[rows] = (np.take_along_axis(x, by, axis=1) for x in (all_d, all_w, all_i))
            reach[rows] = np.minimum(reach[rows], near[rows, -1])

        def below(node: int, rows: np.ndarray) -> np.ndarray:
            """Lower bounds of the distance to each half."""
            d = distances(q[rows], self.wide[self.vantage[node]])
            lo, hi = self.bounds[node][0::2], self.bounds[node][1::2]
            low = np.maximum(d[:, None] - hi, lo - d[:, None])
            return np.maximum(low - SLACK * (d[:, None] + hi), 0)

        # every query to the leaf that looks nearest: something to beat
        done = np.full(m, -1)
        todo = [(0, np.arange(m))]
        while todo:
            node, rows = todo.pop()
            if self.children[node][0] < 0:
                done[rows] = node
                meet(node, rows)
                continue
            low = below(node, rows)
            side = low[:, 1] < low[:, 0]
            todo += [(int(self.children[node][s]), rows[side == s]) for s in (0, 1) if (side == s).any()]
        # the rest, by bounds
        todo_bounds = [(0, np.arange(m), np.zeros(m))]
        while todo_bounds:
            node, rows, low = todo_bounds.pop()
            stays = low <= factor * reach[rows]
            rows, low = rows[stays], low[stays]
            if self.children[node][0] < 0:
                rows = rows[done[rows] != node]
                if len(rows):
                    meet(node, rows)
                continue
            if not len(rows):
                continue
            lows = np.maximum(below(node, rows), low[:, None])
            halves = sorted(((lows[:, s].sum(), int(self.children[node][s]), lows[:, s]) for s in (0, 1)), key=lambda h: -h[0])
            todo_bounds += [(child, rows, x) for _, child, x in halves]
        return near, which, weighed


# --- the index ---------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec (array<float>, or array<double> of other types), key (a digest of the vector) of the rows that take part."""
    kind = vectors.schema[vec_col].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"
    v = common.column(vec_col).cast(f"array<{kind}>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = vectors.select(common.column(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    x = x.filter(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    if not x.groupBy("id").count().filter("count > 1").isEmpty():
        x = x.groupBy("id").agg(F.min("vec").alias("vec"))
    return x.withColumn("key", F.unhex(F.sha2(F.col("vec").cast("string"), 256)))


class Pivots:
    """Pivots by length, and the nearest of each row."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {len(v) for _, v in rows}:
            own = [(i, v) for i, v in rows if len(v) == length]
            self.of[length] = np.array([i for i, _ in own]), np.array([v for _, v in own], dtype=np.float64)

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of that length, a block of rows at a time."""
        _, p = self.of[x.shape[1]]
        return np.stack([distances(x, v) for v in p], axis=1)


def _matrix(vecs: pa.Array, length: int) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _by_length(vecs: pa.Array):
    """For each length: the rows that have it and their matrix."""
    sizes = np.diff(vecs.offsets.to_numpy())
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, _matrix(vecs.take(pa.array(rows)), length)


def placed(x: DataFrame, pivots) -> DataFrame:
    """`x` (key, vec, ...) with length, shard (number of the nearest pivot; -1 where none has that length) and away, the distance to it."""
    held = x.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            shard, away, length = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for n, rows, m in _by_length(b.column("vec")):
                length[rows] = n
                if n in held.value.of:
                    d = held.value.away(m)
                    near = d.argmin(axis=1)
                    shard[rows], away[rows] = held.value.of[n][0][near], d[np.arange(len(rows)), near]
            yield pa.record_batch([*b.columns, pa.array(length), pa.array(shard), pa.array(away)], names=[*b.schema.names, "length", "shard", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema)
    return x.mapInArrow(run, f"{kinds}, length long, shard long, away double")


TREES = "tree long, length long, shard long, radius double, n long, points binary, ids array<array<bigint>>"


def trees(members: DataFrame, pieces: int) -> DataFrame:
    """TREES of members (key, vec, ids, length, shard, away): each range of (length, shard, key) makes a tree for each shard in it."""

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 20, 0

        def tree(rows: pa.Table):
            nonlocal made
            length = rows.column("length")[0].as_py()
            built = Tree.build(_matrix(rows.column("vec").combine_chunks(), length))
            made += 1
            values = [[base + made], [length], [rows.column("shard")[0].as_py()], [max(rows.column("away").to_pylist())], [rows.num_rows], [built.dump()], [rows.column("ids").to_pylist()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["tree", "length", "shard", "radius", "n", "points", "ids"])

        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            where = list(zip(b.column("length").to_pylist(), b.column("shard").to_pylist(), strict=True))
            begin = 0
            for k in range(1, len(where) + 1):
                if k == len(where) or where[k] != where[begin]:
                    if held and (at != where[begin] or sum(h.num_rows for h in held) >= 2 * ROWS):
                        yield tree(pa.Table.from_batches(held))
                        held = []
                    at = where[begin]
                    held.append(b.slice(begin, k - begin))
                    begin = k
        if held:
            yield tree(pa.Table.from_batches(held))

    x = members.select("key", "vec", "ids", "length", "shard", "away").repartitionByRange(pieces, "length", "shard", "key")
    return x.sortWithinPartitions("length", "shard", "key").mapInArrow(run, TREES)


def _answers(queries: DataFrame, index: DataFrame, chunks: int, k: int, factor: float) -> DataFrame:
    """key, near, id: of each query (key, vec, reach, length, shard), the k nearest rows of each tree of that shard, not farther than reach."""

    def search(tree: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = [pa.binary(), pa.float64(), pa.list_(pa.int64())]
        names = ["key", "near", "ids"]
        if not tree.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        t = Tree.load(tree.column("points")[0].as_py())
        ids = tree.column("ids")[0].as_py()
        q = _matrix(asked.column("vec").combine_chunks(), t.points.shape[1])
        near, which, _ = t.search(q, asked.column("reach").to_numpy(), k, factor, np.array([i[0] for i in ids]))
        row, col = np.nonzero(which >= 0)
        key = asked.column("key").combine_chunks().take(pa.array(row))
        return pa.table([key, pa.array(near[row, col]), pa.array([ids[w] for w in which[row, col].tolist()], kinds[2])], names=names)

    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")
    places = index.select(F.col("tree").alias("visits"), "length", "shard")
    asked = queries.join(places, ["length", "shard"]).select("visits", chunk, "key", "vec", "reach")
    grown = index.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "points", "ids")
    found = grown.groupBy("tree", "chunk").cogroup(asked.groupBy("visits", "chunk")).applyInArrow(search, "key binary, near double, ids array<bigint>")
    return found.select("key", "near", F.explode("ids").alias("id"))


def _best(answers: DataFrame, k: int) -> DataFrame:
    """key, rows: the k first (near, id) of each query."""
    first = answers.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("near", "id"))).filter(F.col("place") <= k)
    return first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("near", "id"))).alias("rows"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, rows: int = ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that `is_query` (a condition on `id`) takes, by Euclidean distance."""
    if not 0 < factor <= 1:
        raise ValueError("factor lies above 0 and is at most 1")
    spark = vectors.sparkSession
    x = usable(vectors, id_col, vec_col)
    some = x.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("place") <= k + 1)
    members = common.written(some.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")), "vectors")
    n, longest = members.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_pivots = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * longest), n // rows))
    sample = common.least_hashed(members.select("vec", F.xxhash64("key").alias("h")), "h", n_pivots, ["vec"])
    pivots = Pivots([(i, r["vec"]) for i, r in enumerate(sample.collect())])  # at most MOST_PIVOTS rows
    index = common.written(trees(placed(members, pivots), max(1, n // rows)), "trees")
    radius = {(r["length"], r["shard"]): r["radius"] for r in index.filter("shard >= 0").groupBy("length", "shard").agg(F.max("radius").alias("radius")).collect()}  # one of each pivot at most

    asking = x.filter(is_query)
    keys = common.written(asking.groupBy("key").agg(F.count("*").alias("n"), F.first("vec").alias("vec")), "queries")
    n_queries, total = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chunks = max(1, n_queries // QUERIES)
    home = common.written(placed(keys.drop("n"), pivots), "homes")
    own = common.written(_answers(home.withColumn("reach", F.lit(float("inf"))), index, chunks, k + 1, factor), "own-shard")
    found = own
    if len(radius) > 1:
        reach = F.when(F.size("rows") > k, F.element_at("rows", k + 1)["near"]).otherwise(F.lit(float("inf")))
        known = home.join(_best(own, k + 1).select("key", reach.alias("reach")), "key", "left").fillna(float("inf"), ["reach"])
        found = own.unionByName(_answers(_elsewhere(known, pivots, radius, factor), index, chunks, k + 1, factor))
    best = common.written(_best(found, k + 1).join(keys.select("key", "n"), "key"), "nearest")
    each = common.hot_lookup(asking.select("id", "key"), best, "key", "n", total, F.col("id"))
    others = F.slice(F.filter("rows", lambda r: r["id"] != F.col("id")), 1, k)
    out = each.filter("rows IS NOT NULL").select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "row"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("row.id").alias("vec_id"), F.col("row.near").alias("score"))


def _elsewhere(known: DataFrame, pivots, radius: dict, factor: float) -> DataFrame:
    """Queries (key, vec, reach, length, shard) once for each other shard that may hold something within reach."""
    held = known.sparkSession.sparkContext.broadcast((pivots, radius))

    def run(batches):
        pivots, radius = held.value
        for b in batches:
            reach, home = b.column("reach").to_numpy(zero_copy_only=False), b.column("shard").to_numpy()
            for length, rows, m in _by_length(b.column("vec")):
                if length not in pivots.of:
                    continue
                numbers = pivots.of[length][0]
                d = pivots.away(m)
                far = np.array([radius.get((length, int(s)), -np.inf) for s in numbers])
                low = d - far - SLACK * (d + np.abs(far))
                goes = (low <= factor * reach[rows][:, None]) & (numbers != home[rows][:, None]) & np.isfinite(far)
                i, j = np.nonzero(goes)
                at = pa.array(rows[i])
                yield pa.record_batch([b.column("key").take(at), b.column("vec").take(at), pa.array(reach[rows[i]]), pa.array(np.full(len(i), length)), pa.array(numbers[j])], names=["key", "vec", "reach", "length", "shard"])

    vec = known.schema["vec"].dataType.simpleString()
    return known.select("key", "vec", "reach", "shard").mapInArrow(run, f"key binary, vec {vec}, reach double, length long, shard long")


def op12_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact (factor one): where distances are as even as in these vectors, no smaller factor keeps nine tenths of the neighbours and saves work."""
    return common.tidied(lambda: nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""
