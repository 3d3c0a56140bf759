"""Fits: monotone boosted trees, logistic, isotonic; and the bootstrap by clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


#: Rows that a boosted model is fitted on at most, those with the least hashes; bins of a feature.
FIT_ROWS, BINS = 50_000, 64


class Monotone:
    """Boosted trees for a yes-or-no label, each feature's effect rising (+1), falling (-1) or free (0).

    Trees grow on quantile bins by the second-order gain. A split that would turn a feature's effect round is not made, and the values below a
    split keep to their side of its middle, so the whole model is monotone. Rounds end when held-out rows have gained nothing for
    `patience` of them. The trees are emitted as column expressions, so scoring needs no Python.
    """

    def __init__(self, columns: list[str], signs: list[int], rounds: int = 100, rate: float = 0.1, depth: int = 3, least: float = 20.0, l2: float = 1.0, patience: int = 8):
        self.columns, self.signs, self.rounds, self.rate, self.depth, self.least, self.l2, self.patience = columns, signs, rounds, rate, depth, least, l2, patience
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Monotone:
        if not len(y):
            return self
        held = np.arange(len(y)) % 10 == 9
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        share = min(1 - 1e-6, max(1e-6, float(np.average(y, weights=w))))
        self.base = float(np.log(share / (1 - share)))
        f, best, wait, keep = np.full(len(y), self.base), np.inf, 0, 0
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, np.where(held, 0, w * (p - y)), np.where(held, 0, w * p * (1 - p)), ~held, self.depth, -np.inf, np.inf)
            self.trees.append(tree)
            f = f + self._add(tree, binned, np.arange(len(y)))
            p = np.clip(1 / (1 + np.exp(-f)), 1e-12, 1 - 1e-12)
            loss = -np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=np.where(held, w, 0)) if held.any() else -np.inf
            if loss < best - 1e-6 or not held.any():
                best, wait, keep = loss, 0, len(self.trees)
            elif (wait := wait + 1) >= self.patience:
                break
        self.trees = self.trees[:keep]
        return self

    def _value(self, g: float, h: float, low: float, high: float) -> float:
        return float(min(high, max(low, -self.rate * g / (h + self.l2))))

    def _grow(self, binned, g, h, inside, depth, low, high):
        """A leaf's value, or (feature, bin, left, right): rows with a bin of at most `bin` go left."""
        rows = np.flatnonzero(inside)
        here = self._value(g[rows].sum(), h[rows].sum(), low, high)
        best = None
        if depth and len(rows) >= 2 * self.least:
            score = lambda a, b: a * a / (b + self.l2)
            for j, cuts in enumerate(self.cuts):
                size = len(cuts) + 1
                gs, hs, n = (np.cumsum(np.bincount(binned[rows, j], weights=v, minlength=size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                g_all, h_all = g[rows].sum(), h[rows].sum()
                gain = score(gs, hs) + score(g_all - gs, h_all - hs) - score(g_all, h_all)
                left, right = (np.clip(-self.rate * a / (b + self.l2), low, high) for a, b in ((gs, hs), (g_all - gs, h_all - hs)))
                ok = (n >= self.least) & (len(rows) - n >= self.least) & ((right - left) * self.signs[j] >= 0)
                if ok.any() and (best is None or gain[ok].max() > best[0]):
                    k = int(np.flatnonzero(ok)[np.argmax(gain[ok])])
                    best = (float(gain[k]), j, k, float(left[k]), float(right[k]))
        if best is None or best[0] <= 1e-9:
            return here
        _, j, k, left, right = best
        middle, sign = (left + right) / 2, self.signs[j]
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[sign]
        down = binned[:, j] <= k
        return (j, k, self._grow(binned, g, h, inside & down, depth - 1, *bounds[0]), self._grow(binned, g, h, inside & ~down, depth - 1, *bounds[1]))

    def _add(self, tree, binned, rows) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        j, k, left, right = tree
        down, out = binned[rows, j] <= k, np.empty(len(rows))
        out[down], out[~down] = self._add(left, binned, rows[down]), self._add(right, binned, rows[~down])
        return out

    def log_odds(self) -> Column:
        """A null feature goes right in every split."""

        def column(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            j, k, left, right = tree
            return F.when(F.col(self.columns[j]) <= F.lit(float(self.cuts[j][k])), column(left)).otherwise(column(right))

        parts = [F.lit(self.base), *map(column, self.trees)]
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, v: a + v)

    def probability(self, clip: float = 1e-4) -> Column:
        p = 1 / (1 + F.exp(-self.log_odds()))
        return F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))


def boosted(df: DataFrame, columns: list[str], label: str, keys: list[str], signs: list[int] | None = None, negative_share: float = 0.25, rounds: int = 100, most: int = FIT_ROWS) -> Monotone:
    """Monotone boosted trees on at most `most` rows, those with the least hashes of `keys`; negatives are sampled and weighted up."""
    kept = F.pmod(F.xxhash64(*keys, F.lit("negative")), F.lit(1_000_003)) < F.lit(negative_share * 1_000_003)
    some = df.filter((F.col(label) == 1) | ((F.col(label) == 0) & kept)).dropna(subset=columns)
    some = some.orderBy(F.xxhash64(*keys), *keys).limit(most).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y")).toPandas()
    y = some["_y"].to_numpy()
    return Monotone(columns, signs or [0] * len(columns), rounds).fit(some[columns].to_numpy(), y, np.where(y == 1, 1.0, 1 / negative_share))


def logistic(df: DataFrame, columns: list[str], label: str, c: float = 1.0):
    """Standardised logistic regression with the penalty 1 / (c n)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol=label, standardization=True, regParam=1 / (c * max(1, df.count()))).fit(_assembled(df, columns))


def scored(model, df: DataFrame, columns: list[str], out: str = "p", clip: float = 1e-4) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(_assembled(df, columns)).withColumn(out, F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))).drop("features", "rawPrediction", "probability", "prediction")


def isotonic(df: DataFrame, p: str, label: str) -> tuple[list[float], list[float]]:
    """Knots of an isotonic fit on a grid of the scores' quantiles, so the driver gets at most 101 of them."""
    from pyspark.ml.regression import IsotonicRegression

    cuts = df.approxQuantile(p, [k / 100 for k in range(101)], 0.001)
    binned = df.withColumn("_b", sum(((F.col(p) > c).cast("int") for c in cuts), F.lit(0))).groupBy("_b").agg(F.avg(p).alias("x"), F.avg(label).alias("y"), F.count("*").cast("double").alias("w"))
    m = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(binned)
    return m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 200) -> DataFrame:
    """2.5 and 97.5 % of the mean under resampling of clusters: sums per cluster meet Poisson(1) weights from hashes, so only
    clusters x draws small rows arise."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = F.pmod(F.xxhash64(cluster, "draw"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    steps, w = [0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941], F.lit(0)
    for s in steps:
        w = w + (u > s).cast("int")
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", w).groupBy("draw").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    return each.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
