"""Least squares from sums that add and subtract: leave one group out without fitting anew on rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    terms = [(1 if j % 2 == 0 else -1) * m[0][j] * _determinant([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return reduce(lambda a, b: a + b, terms)


def solved(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer's rule for a few unknowns as expressions; null where there is no single solution."""
    d = _determinant(a)
    return [F.try_divide(_determinant([row[:j] + [b[i]] + row[j + 1 :] for i, row in enumerate(a)]), d) for j in range(len(b))]


def leave_one_out(df: DataFrame, site: str, group: str, x: list[str], y: str, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Within-site least squares, each group (a year) held out in turn: (fits, rows).

    Both come from one table of sums by site and group. What a fit needs of a site without one group are the site's sums less the
    group's, so no row is read once per group. fits: group, n (training rows), b_<x>; a group with fewer than `least` training rows has none. rows: `df` with the
    prediction `within` (around the site's training mean) and `level` (with it), null where the site has no row in the training groups or the fit
    has no single solution. Rows with a null in any of the columns take no part.
    """
    names = [*x, y]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    d = df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [site, group, *names])))
    sums = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]]
    sums += [F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs]
    by = d.groupBy(site, group).agg(*sums)
    columns = [c for c in by.columns if c not in (site, group)]
    whole = by.groupBy(site).agg(*[F.sum(c).alias(f"w_{c}") for c in columns])
    # a group's training sums: of the sites that have it their other groups, of all other sites everything
    centred = lambda p: {f"c{i}_{j}": F.coalesce(F.col(f"{p}q{i}_{j}") - F.try_divide(F.col(f"{p}s{i}") * F.col(f"{p}s{j}"), F.col(f"{p}n")), F.lit(0.0)) for i, j in pairs}
    left = by.join(whole, site).select(site, group, *[(F.col(f"w_{c}") - F.col(c)).alias(f"t_{c}") for c in columns], *[F.col(f"w_{c}") for c in columns])
    change = left.select(group, (F.col("t_n") - F.col("w_n")).alias("n"), *[(a - b).alias(k) for (k, a), b in zip(centred("t_").items(), centred("w_").values(), strict=True)])
    total = whole.select(F.col("w_n").alias("n"), *[v.alias(k) for k, v in centred("w_").items()])
    parts = ["n", *centred("w_")]
    total = total.agg(*[F.sum(c).alias(f"all_{c}") for c in parts])  # one row
    fits = change.groupBy(group).agg(*[F.sum(c).alias(c) for c in parts]).crossJoin(F.broadcast(total)).select(group, *[(F.col(c) + F.col(f"all_{c}")).alias(c) for c in parts])
    k = len(x)
    at = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
    beta = solved([[at(i, j) for j in range(k)] for i in range(k)], [at(i, k) for i in range(k)])
    fits = fits.filter(F.col("n") >= least).select(group, "n", *[b.alias(f"b_{c}") for b, c in zip(beta, x, strict=True)])
    means = left.filter("t_n > 0").select(site, group, *[F.try_divide(f"t_s{i}", "t_n").alias(f"m{i}") for i in range(k + 1)])
    within = reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"m{i}")) * F.col(f"b_{c}") for i, c in enumerate(x)))
    rows = d.join(means, [site, group], "left").join(fits.drop("n"), group, "left").withColumn("within", within).withColumn("level", F.col("within") + F.col(f"m{k}"))
    return fits, rows.select(*df.columns, "within", "level")
