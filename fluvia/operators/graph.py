"""Directed networks as edge tables: closure, reach, components, walks."""

from __future__ import annotations

import atexit
import shutil
import uuid
from functools import reduce
from itertools import count
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_written: list[str] = []


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or "file:///tmp/checkpoints/fluvia").rstrip("/")


def _step(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: a table written in the folder of spark.checkpoint.dir, computed once."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/fluvia-step-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def path_of(step: DataFrame) -> str:
    """Where a step's table is."""
    return step._step_path


def parent(step: DataFrame) -> str:
    return path_of(step).rpartition("/")[0]


def _drop(spark, steps: list[DataFrame]) -> None:
    """Delete steps that nothing reads any more."""
    for path in {path_of(s) for s in steps}:
        _written.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    """At exit nothing lazy is left that reads them."""
    for path in _written:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(unquote(urlparse(path).path), ignore_errors=True)


#: Edges that a round of `closure` follows before it compares distances, and rounds whose deltas are kept apart.
HOPS, DELTAS = 4, 8


def closure(edges: DataFrame, roots: DataFrame, cap: float, most_rounds: int | None = None) -> DataFrame:
    """root, node, dist: nodes within `cap` along edges (src, dst, length) against their direction from each root.

    Only nodes whose distance fell in the last round are expanded, HOPS edges at a time, until none fell; shortest distances are kept. What was
    reached is kept as the rounds' deltas, which are put together once in DELTAS rounds. Joins are by sorting, so that no round sends a copy of the edges through the driver. An error if `most_rounds` edges in a row don't suffice.
    """
    reached = [_step(roots.select(F.col("node").alias("root"), "node", F.lit(0.0).alias("dist")).distinct())]
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("up"), "length")
    least = lambda x: x.groupBy("root", "node").agg(F.min("dist").alias("dist"))
    front = reached[0]
    for k in count():
        if most_rounds is not None and k * HOPS >= most_rounds:
            raise RuntimeError(f"unfinished after {most_rounds} edges")
        hop, met = front, None
        for _ in range(HOPS):
            hop = hop.join(back.hint("merge"), "node").select("root", F.col("up").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).filter(F.col("dist") <= cap)
            met = hop if met is None else met.unionByName(hop)
        old = reduce(DataFrame.unionByName, reached)
        front = _step(least(met).join(least(old).withColumnRenamed("dist", "old").hint("merge"), ["root", "node"], "left").filter("old IS NULL OR dist < old").select("root", "node", "dist"))
        if front.isEmpty():
            return least(old)
        reached.append(front)
        if len(reached) > DELTAS:
            parts, reached = reached, [_step(least(reduce(DataFrame.unionByName, reached)))]
            _drop(edges.sparkSession, parts[:-1])  # the last is the front


#: Edges that one task may finish (a few dozen bytes each there).
FEW_EDGES = 1 << 17


class Cyclic(Exception):
    """A cycle is in the way of contraction."""


def accumulate(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, upstream: the length of edges (src, dst, length) above each node; where branches join again, each path counts.

    By contraction: what a node has above it is a linear function of what another has, so runs of nodes that one edge enters shrink by pointer
    doubling to their first node's, nodes that nothing enters are done and pass their sums on, and only nodes where several edges meet are left for the next round.
    Rounds grow with the logarithm of the nodes, on a chain as on a tree. At `few` edges one task finishes the rest. Cycles are taken in the order of their
    nodes, each adding those before it: a graph of more than `few` edges that has one goes the way of `accumulate_in_order`.
    """
    e = _step(edges.select("src", "dst", F.lit(1.0).alias("m"), F.col("length").cast("double").alias("c")))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    if e.count() <= few:
        return _finished(e, nodes.withColumn("base", F.lit(0.0)))
    try:
        return _contracted(e, _step(nodes.withColumn("base", F.lit(0.0))), few)
    except Cyclic:
        return accumulate_in_order(edges)


def _contracted(e: DataFrame, base: DataFrame, few: int) -> DataFrame:
    """`accumulate` of edges (src, dst, m, c), each of which adds m times its source's sum and c, on nodes that have `base` already."""
    rounds = []
    while True:
        e = _step(e.groupBy("src", "dst").agg(F.sum("m").alias("m"), F.sum("c").alias("c")))
        n = e.count()
        if n <= few:
            rest = _step(_finished(e, base, cycles=False))
            if rest.filter("upstream IS NULL").count():
                raise Cyclic
            break
        into = e.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("anc"), F.first("m").alias("m"), F.first("c").alias("k"))
        x = base.join(into.withColumnRenamed("dst", "node"), "node", "left")
        heads_ = _step(x.filter("n IS NULL").select("node", F.col("base").alias("upstream")))
        runs = _step(x.filter("n = 1").select("node", "anc", "m", (F.col("k") + F.col("base")).alias("k")))
        meets = _step(x.filter("n > 1").select("node", "base"))
        size = runs.count()
        if not size and heads_.isEmpty():
            raise Cyclic
        for _ in range(size.bit_length() + 1):  # pointers double, so a run of any length ends in so many steps, or never
            ahead = runs.select(F.col("node").alias("_n"), F.col("anc").alias("_a"), F.col("m").alias("_m"), F.col("k").alias("_k"))
            if runs.join(ahead, runs.anc == F.col("_n"), "left_semi").isEmpty():
                break
            far = F.coalesce("_m", F.lit(1.0))
            runs = _step(runs.join(ahead, runs.anc == F.col("_n"), "left").select("node", F.coalesce("_a", "anc").alias("anc"), (F.col("m") * far).alias("m"), (F.col("m") * F.coalesce("_k", F.lit(0.0)) + F.col("k")).alias("k")))
        else:
            raise Cyclic
        rounds.append((heads_, runs))
        # edges into the meeting nodes, from the first nodes of the runs that they come from
        left = e.join(meets.select(F.col("node").alias("dst")), "dst", "left_semi")
        by = runs.select(F.col("node").alias("src"), "anc", F.col("m").alias("rm"), "k")
        left = left.join(by, "src", "left").select(F.coalesce("anc", "src").alias("src"), "dst", (F.col("m") * F.coalesce("rm", F.lit(1.0))).alias("m"), (F.col("m") * F.coalesce("k", F.lit(0.0)) + F.col("c")).alias("c"))
        known = left.join(heads_.withColumnRenamed("node", "src"), "src", "left")
        known = _step(known)
        paid = known.filter("upstream IS NOT NULL").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("m") * F.col("upstream") + F.col("c")).alias("paid"))
        base = _step(meets.join(paid, "node", "left").select("node", (F.col("base") + F.coalesce("paid", F.lit(0.0))).alias("base")))
        e = known.filter("upstream IS NULL").select("src", "dst", "m", "c")
    for heads_, runs in reversed(rounds):
        rest = rest.unionByName(heads_)
        filled = runs.join(rest.select(F.col("node").alias("anc"), "upstream"), "anc").select("node", (F.col("m") * F.col("upstream") + F.col("k")).alias("upstream"))
        rest = _step(rest.unionByName(filled))
    return rest


def _finished(e: DataFrame, base: DataFrame, cycles: bool = True) -> DataFrame:
    """`accumulate` in one task, for as few edges as it may hold; without `cycles` nodes on and below one get null."""
    kind = dict(e.dtypes)["dst"]
    rows = e.select("src", "dst", "m", "c").unionByName(base.select(F.lit(None).cast(dict(e.dtypes)["src"]).alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("m"), F.col("base").alias("c")))

    def run(batches):
        into: dict = {}
        start: dict = {}
        for b in batches:
            for s, d, m, c in zip(*(b.column(n).to_pylist() for n in ("src", "dst", "m", "c")), strict=True):
                if s is None:
                    start[d] = start.get(d, 0.0) + c
                else:
                    into.setdefault(d, []).append((s, m, c))
        up: dict = {}
        for group in _strong(start, into):
            loop = len(group) > 1 or any(s == group[0] for s, _, _ in into.get(group[0], ()))
            for v in sorted(group):
                known = [(up[s], m, c) for s, m, c in into.get(v, ()) if s in up]
                bad = not cycles and (loop or any(u is None for u, _, _ in known))
                up[v] = None if bad else start[v] + sum(m * u + c for u, m, c in known)
        yield pa.record_batch([pa.array(list(up), pa_kind), pa.array(list(up.values()), pa.float64())], names=["node", "upstream"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(e.schema["dst"].dataType)
    return rows.coalesce(1).mapInArrow(run, f"node {kind}, upstream double")


def _strong(nodes, into: dict):
    """Strongly connected components, those above first: depth first along the edges that enter, without recursion."""
    number: dict = {}
    low: dict = {}
    stack: list = []
    waiting: set = set()
    for root in nodes:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        waiting.add(root)
        walk = [(root, iter(into.get(root, ())))]
        while walk:
            v, above = walk[-1]
            for u, _, _ in above:
                if u not in number:
                    number[u] = low[u] = len(number)
                    stack.append(u)
                    waiting.add(u)
                    walk.append((u, iter(into.get(u, ()))))
                    break
                if u in waiting:
                    low[v] = min(low[v], number[u])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        waiting.discard(group[-1])
                    yield group


def accumulate_in_order(edges: DataFrame) -> DataFrame:
    """`accumulate` level by level, in topological order, for large graphs with cycles.

    A node passes its sum on when all that flow into it have; each edge carries one row once. Where only cycles and what lies below them are
    left, a cycle without another above it is taken in the order of its nodes, each adding those before it (in one task: the order is one
    after another by its nature).
    """
    inbox = None  # partial sums of nodes that wait
    left = _step(edges.select("src", "dst", "length"))
    open_ = _step(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    done = []
    while not open_.isEmpty():
        ready = open_.join(left, open_.node == left.dst, "left_anti")
        sums = inbox.groupBy("node").agg(F.sum("amount").alias("amount")) if inbox is not None else None
        totals = ready.withColumn("upstream", F.lit(0.0)) if sums is None else ready.join(sums, "node", "left").select("node", F.coalesce("amount", F.lit(0.0)).alias("upstream"))
        totals = _step(totals)
        if totals.isEmpty():
            totals = _step(_cycle(left, inbox))
        done.append(totals)
        sent = left.join(totals, left.src == totals.node).select(F.col("dst").alias("node"), (F.col("upstream") + F.col("length")).alias("amount"))
        gone = totals.select(F.col("node").alias("_n"))
        waiting = sent if inbox is None else inbox.unionByName(sent)
        inbox = _step(waiting.join(gone, waiting.node == gone._n, "left_anti"))
        left = _step(left.join(gone, left.src == gone._n, "left_anti").join(gone.withColumnRenamed("_n", "_m"), F.col("dst") == F.col("_m"), "left_anti"))
        open_ = _step(open_.join(gone, open_.node == gone._n, "left_anti"))
    none = edges.select(F.col("src").alias("node"), F.lit(0.0).alias("upstream")).limit(0)
    return reduce(DataFrame.unionByName, done, none)


def _cycle(left: DataFrame, inbox: DataFrame | None) -> DataFrame:
    """node, upstream of one cycle (a strongly connected component) that no other node waits above."""
    at = left.agg(F.min("dst")).first()[0]
    while True:
        one = left.select(F.col("dst").alias("node")).filter(F.col("node") == F.lit(at)).limit(1)
        above = closure(left, one, float("inf")).select("node")
        below = closure(reversed_edges(left), one, float("inf")).select("node")
        other = above.join(below, "node", "left_anti").agg(F.min("node")).first()[0]
        if other is None:
            break
        at = other  # a node above that is not of this cycle
    inner = left.join(above.withColumnRenamed("node", "_a"), F.col("dst") == F.col("_a")).drop("_a")
    came = None if inbox is None else inbox.join(above, "node").groupBy("node").agg(F.sum("amount").alias("amount"))
    rows = inner.select("src", "dst", "length")
    if came is not None:
        rows = rows.unionByName(came.select(F.lit(None).cast(dict(rows.dtypes)["src"]).alias("src"), F.col("node").alias("dst"), F.col("amount").alias("length")))

    def run(pdf):
        up = {}
        for n, part in sorted(pdf.groupby("dst"), key=lambda kv: kv[0]):
            up[n] = sum(length + (0.0 if s != s or s is None else up[s]) for s, length in zip(part.src, part.length, strict=True) if s != s or s is None or s in up)
        return pd.DataFrame({"node": list(up), "upstream": [float(v) for v in up.values()]})

    return rows.groupBy().applyInPandas(run, f"node {dict(rows.dtypes)['dst']}, upstream double")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")


def heads(edges: DataFrame) -> DataFrame:
    """Nodes without an edge that ends there."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return heads(reversed_edges(edges))


def min_label(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, label: the smallest node of its connected component. An error if `most_rounds` don't suffice."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = _step(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for k in count():
        if k == most_rounds:
            raise RuntimeError(f"unfinished after {most_rounds} rounds")
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.src, "left").select("node", F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = _step(new.join(jump, new.label == jump._n).select("node", F.least("label", "_l").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old")
        labels = new
        if changed.isEmpty():
            break
    return labels
