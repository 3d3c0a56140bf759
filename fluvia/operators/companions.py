"""Who meets whom most often, without a row for each pair that met."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.operators.graph import _step

#: A block holds about so many classes and so many of their entries; a task meets two blocks and counts in one row of the right block's length.
BLOCK, ENTRIES = 32768, 1 << 21
#: Few classes are still dealt to this many blocks, of this many classes at least.
LEAST_BLOCKS, LEAST_BLOCK = 12, 1024


def most_frequent(counts: DataFrame, who: str, kind: str, slot: str, n: str, block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """Of each `who` (whole number) the other one with the greatest sum of n * n over equal (kind, slot), the smallest of equals: columns `who` and `other`.

    `counts` has one row per who, kind (string) and slot (whole number). Those with the same counts throughout are one class: its smallest two answer for it, inside
    by the class's own product. Classes meet block by block: a task holds two blocks, adds up one class's products at a time and keeps the best, so
    what is moved grows with the classes times the blocks and no pair is written. Rows with nulls meet nobody.
    """
    x = counts.dropna(subset=[who, kind, slot]).select(F.col(who).alias("who"), F.col(kind).alias("kind"), F.struct(F.col(slot).cast("long").alias("h"), F.col(n).cast("long").alias("m")).alias("run"))
    x = x.repartition("who").groupBy("who", "kind").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    x = x.groupBy("who").agg(F.sort_array(F.collect_list(F.struct("kind", "runs"))).alias("profile"))
    own = F.aggregate("profile", F.lit(0).cast("long"), lambda a, p: F.aggregate(p["runs"], a, lambda b, r: b + r["m"] * r["m"]))
    size = F.aggregate("profile", F.lit(0).cast("long"), lambda a, p: a + F.size(p["runs"]))
    x = _step(x.select("who", F.sha2(F.to_json("profile"), 256).alias("name"), own.alias("own"), size.alias("size"), "profile"))
    classes = x.groupBy("name").agg(F.min("who").alias("lead"), F.first("size").alias("size"))
    known, total = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    members = x.select("who", "name", "own").join(classes.select("name", "lead"), "name").drop("name")
    second = members.filter("who <> lead").groupBy("lead").agg(F.min("who").alias("second"))
    blocks = max(1, -(-known // block), -(-total // entries), min(LEAST_BLOCKS, known // LEAST_BLOCK))
    rows = x.join(classes.select(F.col("lead").alias("who")), "who", "left_semi").select("who", "profile", F.pmod(F.xxhash64("who"), F.lit(blocks)).cast("int").alias("block"))
    left = rows.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), "who", "profile")
    right = rows.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("who").alias("who"), F.col("profile").alias("profile"))
    tasks = blocks * (blocks + 1) // 2
    met = left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(right.repartition(tasks, "i", "j").groupBy("i", "j"))
    met = met.applyInArrow(_meet, "lead long, n long, other long").groupBy("lead").agg(F.max(F.struct("n", (-F.col("other")).alias("o"))).alias("out"))
    out = members.join(met, "lead", "left").join(second, "lead", "left")
    twin = F.when(F.col("who") == F.col("lead"), F.col("second")).otherwise(F.col("lead"))
    best = F.greatest("out", F.when(twin.isNotNull(), F.struct(F.col("own").alias("n"), (-twin).alias("o"))))
    return out.select("who", (-best["o"]).alias("other")).filter("other IS NOT NULL").withColumnRenamed("who", who)


def _entries(t: pa.Table):
    """The numbers of `t` in ascending order, and of each entry the place of its number, its kind, slot and count, by place."""
    t = t.sort_by("who")
    profile = t["profile"].combine_chunks()
    kinds, owner = pc.list_flatten(profile), pc.list_parent_indices(profile).to_numpy()
    runs = kinds.field("runs")
    of, run = pc.list_parent_indices(runs).to_numpy(), pc.list_flatten(runs)
    return t["who"].to_numpy(), owner[of], kinds.field("kind"), of, run.field("h").to_numpy(), run.field("m").to_numpy()


def _meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Each number of either side with the best of the other side; of one block with itself, the best of the others in it."""
    same = key[0].as_py() == key[1].as_py()
    schema = pa.schema([("lead", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a, a_at, a_kinds, a_kind, a_slot, a_m = _entries(left)
    b, b_at, b_kinds, b_kind, b_slot, b_m = _entries(right)
    kinds = pa.concat_arrays([a_kinds, b_kinds]).dictionary_encode().indices.to_numpy().astype(np.int64)
    slots, at = np.unique(np.concatenate([a_slot, b_slot]), return_inverse=True)
    a_cell, b_cell = kinds[a_kind] * len(slots) + at[: len(a_slot)], kinds[len(a_kinds) + b_kind] * len(slots) + at[len(a_slot) :]
    plain = a_m.sum() <= 2 * len(a_m) and b_m.sum() <= 2 * len(b_m)
    if plain:  # counts are mostly one: repeated entries are added up faster than weights
        a_at, a_cell, b_at, b_cell = np.repeat(a_at, a_m), np.repeat(a_cell, a_m), np.repeat(b_at, b_m), np.repeat(b_cell, b_m)
    order = np.argsort(b_cell, kind="stable")
    b_cell, b_at = b_cell[order], b_at[order]
    begin, end = np.searchsorted(b_cell, a_cell, "left"), np.searchsorted(b_cell, a_cell, "right")
    if not plain:
        b_m = b_m[order]
    bounds = np.searchsorted(a_at, np.arange(len(a) + 1))
    a_n, a_best, b_n, b_best = (np.zeros(len(x), np.int64) for x in (a, a, b, b))
    for k in range(len(a)):
        its = [(e, f, g) for e, f, g in zip(range(bounds[k], bounds[k + 1]), begin[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]], strict=True) if f < g]
        if not its:
            continue
        found = np.concatenate([b_at[f:g] for _, f, g in its])
        if plain:
            n = np.bincount(found, minlength=len(b))
        else:
            n = np.zeros(len(b), np.int64)
            np.add.at(n, found, np.concatenate([b_m[f:g] * a_m[e] for e, f, g in its]))
        if same:
            n[k] = 0
        a_best[k] = n.argmax()
        a_n[k] = n[a_best[k]]
        if not same:
            more = np.flatnonzero(n > b_n)
            b_n[more], b_best[more] = n[more], k
    out = [np.concatenate([a, b]), np.concatenate([a_n, b_n]), np.concatenate([b[a_best], a[b_best]])]
    return pa.table([pa.array(c[out[1] > 0]) for c in out], schema=schema)
