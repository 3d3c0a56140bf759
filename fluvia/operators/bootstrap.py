"""Cluster bootstrap of the area under the curve and of the mean squared error, from histograms of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws that are taken, and bins of the score from 0 to 1; a block of draws is what a task weighs at once.
DRAWS, BINS, BLOCK = 2000, 256, 250
_MASK = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each cluster (a 64-bit hash) is drawn in each draw: Poisson of mean one from a hash of both, so a lost task draws the same again."""
    with np.errstate(over="ignore"):
        u = _mixed(_mixed(keys.astype(np.uint64))[None, :] + draws.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64
    cut = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    return np.searchsorted(cut, u, side="right").astype(np.float64)


def area(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """The area under the curve of rows of histograms: shares of pairs in which the positive scores higher, ties in a bin as halves."""
    below = np.cumsum(neg, axis=1) - neg
    with np.errstate(invalid="ignore", divide="ignore"):
        return (pos * (below + neg / 2)).sum(axis=1) / (pos.sum(axis=1) * neg.sum(axis=1))


def auc_draws(df: DataFrame, cluster: str, score: str, label: str, draws: int = DRAWS, bins: int = BINS) -> DataFrame:
    """draw, auc, brier of each draw (draw 0 is the rows as they are).

    A cluster becomes one row of counts by bin and label before anything is drawn; a task multiplies draws' weights with its clusters' histograms and sends one sum for
    each draw, so what moves does not grow with the rows, and a cluster with a third of them is a row like others. Scores lie from 0 to 1; rows with nulls take no part.
    """
    x = df.filter(F.col(cluster).isNotNull() & F.col(score).isNotNull() & F.col(label).isNotNull())
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    cells = x.groupBy(F.xxhash64(cluster).alias("c"), (at * 2 + F.col(label).cast("int")).alias("cell")).agg(F.count("*").alias("n"), F.sum(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("e"))
    rows = cells.groupBy("c").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"), F.sum("e").alias("e"), F.sum("n").alias("all"))  # at most two cells a bin
    blocks = -(-(draws + 1) // BLOCK)

    def run(batches):
        sums = None
        for b in batches:
            h = np.zeros((b.num_rows, 2 * bins + 2))
            for i, (cell, n) in enumerate(zip(b.column("cell").to_pylist(), b.column("n").to_pylist(), strict=True)):
                h[i, cell] = n
            h[:, -2], h[:, -1] = b.column("e").to_numpy(), b.column("all").to_numpy()
            key = b.column("c").to_numpy().view(np.uint64)
            if sums is None:
                sums = np.zeros((draws + 1, 2 * bins + 2))
            for k in range(blocks):
                d = np.arange(k * BLOCK, min((k + 1) * BLOCK, draws + 1))
                w = weights(key, d)
                w[d == 0] = 1
                sums[d] += w @ h
        if sums is not None:
            yield pa.record_batch([pa.array(np.arange(draws + 1)), pa.array(list(sums), pa.list_(pa.float64()))], names=["draw", "h"])

    def scored(t: pa.Table) -> pa.Table:
        h = np.array(t.column("h").to_pylist()).sum(axis=0)
        auc = area(h[None, 1 : 2 * bins : 2], h[None, 0 : 2 * bins : 2])[0]
        return pa.table({"draw": t.column("draw").slice(0, 1), "auc": pa.array([None if np.isnan(auc) else float(auc)], pa.float64()), "brier": pa.array([float(h[-2] / h[-1]) if h[-1] else None], pa.float64())})

    return rows.mapInArrow(run, "draw long, h array<double>").groupBy("draw").applyInArrow(scored, "draw long, auc double, brier double")


def intervals(draws: DataFrame) -> DataFrame:
    """measure, estimate (draw 0), low and high (2.5 and 97.5 per cent of the draws)."""
    out = None
    for m in ("auc", "brier"):
        q = F.percentile(F.when(F.col("draw") > 0, F.col(m)), F.array(F.lit(0.025), F.lit(0.975)))  # of DRAWS numbers
        row = draws.agg(F.lit(m).alias("measure"), F.max(F.when(F.col("draw") == 0, F.col(m))).alias("estimate"), q[0].alias("low"), q[1].alias("high"))
        out = row if out is None else out.unionByName(row)
    return out
