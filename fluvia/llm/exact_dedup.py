"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when they are identical after each run of white space is one space. A snapshot is a table of digests in
buckets, with one binary-fuse filter (8-bit fingerprints, about nine bits a digest) per bucket, written once and never
changed. New documents are grouped among themselves first (with partial aggregation, so a group with a third of all rows is a
row per task); their distinct digests meet the filter of their bucket; only positives are joined with the bucket
itself. Before any row is dropped, the bytes of the texts are compared, not just their digests.

Edge cases: null text counts as empty and so equals an empty text; rows with a null id never stay while a row with an id
does; repeated rows form a group; an empty table gives an empty result; extra columns are kept by `deduplicated` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import mix64

#: Digests a bucket holds on average.
BUCKET_KEYS = 4096

#: A run of white space that is not one space; `[\x20\t-\r]+` to one space, with fewer replacements.
WHITE = "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


# --- binary-fuse filters -----------------------------------------------------------------------------------------


class FuseFilter:
    """A static 3-wise binary-fuse filter over 64-bit keys: no false negatives, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        begin = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        within = np.uint64(segment - 1)
        low = [(h & within), ((h >> np.uint64(18)) & within), (mix64(h + np.uint64(1)) & within)]
        return np.stack([(begin + i) * segment + x.astype(np.int64) for i, x in enumerate(low)]), (mix64(h + np.uint64(2)) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels the 3-partite graph of keys and slots in rounds; another seed where that fails."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, seed, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            mixed = np.zeros(size, dtype=np.int64)  # xor of the keys' numbers at each slot
            for row in slots:
                np.bitwise_xor.at(mixed, row, np.arange(n))
            order: list[tuple[np.ndarray, np.ndarray]] = []
            alone, done = np.flatnonzero(count == 1), 0
            while len(alone):
                which, first = np.unique(mixed[alone], return_index=True)
                order.append((which, alone[first]))
                done += len(which)
                touched = slots[:, which]
                np.subtract.at(count, touched.ravel(), 1)
                for row in touched:
                    np.bitwise_xor.at(mixed, row, which)
                touched = np.unique(touched)
                alone = touched[count[touched] == 1]
            if done == n:
                table = np.zeros(size, dtype=np.uint8)
                for which, slot in reversed(order):
                    table[slot] = 0
                    table[slot] = prints[which] ^ table[slots[0, which]] ^ table[slots[1, which]] ^ table[slots[2, which]]
                return cls(seed, segment, segments, table)
        raise ValueError("no seed peels")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        s, p = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[s[0]] ^ self.prints[s[1]] ^ self.prints[s[2]]) == p

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype="<u4").tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> FuseFilter:
        return cls(*map(int, np.frombuffer(blob[:12], dtype="<u4")), np.frombuffer(blob[12:], dtype=np.uint8))


def _keys(sha: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(x[:16] for x in sha.to_pylist())), dtype=">u8").astype(np.uint64)


# --- snapshots ---------------------------------------------------------------------------------------------------


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha: hex SHA-256 of the normalised text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(common.text_of()), 256).alias("sha"))


def grouped(keyed: DataFrame) -> DataFrame:
    """sha, keep (smallest doc_id), n: one row per digest."""
    return keyed.groupBy("sha").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)))


def snapshot(groups: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (bucket, sha, keep, n) and (bucket, filter) of one immutable snapshot."""
    held = common.written(bucketed(groups, buckets), "dedup-snapshot")

    def build(table: pa.Table) -> pa.Table:
        f = FuseFilter.build(_keys(table.column("sha")))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([f.dump()], pa.binary())})

    filters = held.select("bucket", "sha").groupBy("bucket").applyInArrow(build, "bucket long, filter binary")
    return held, common.written(filters, "dedup-filters")


def screened(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Distinct incoming digests (sha, keep, n) with `maybe`: false where the snapshot cannot hold the digest."""

    def screen(new: pa.Table, held: pa.Table) -> pa.Table:
        maybe = np.zeros(new.num_rows, dtype=bool)
        if held.num_rows and new.num_rows:
            maybe = FuseFilter.load(held.column("filter")[0].as_py()).holds(_keys(new.column("sha")))
        return new.select(["sha", "keep", "n"]).append_column("maybe", pa.array(maybe))

    left = bucketed(incoming, buckets).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInArrow(screen, "sha string, keep long, n long, maybe boolean")


def merged(held: DataFrame, new: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: positives join the exact buckets, negatives pass by."""
    new = new.withColumnsRenamed({"keep": "new_keep", "n": "new_n"})
    met = held.select("sha", "keep", "n").join(new.filter("maybe").drop("maybe"), "sha", "full")
    met = met.select("sha", F.least("keep", "new_keep").alias("keep"), (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"))
    return met.unionByName(new.filter("NOT maybe").select("sha", F.col("new_keep").alias("keep"), F.col("new_n").alias("n")))


def unequal(docs: DataFrame, groups: DataFrame) -> int:
    """Digests of groups whose normalised texts are not the same bytes: the check before anything is dropped.

    A text goes to its group's task as the least and the greatest of the texts of its input task, so a group with a third
    of all rows is a row per task. A bitmap sized by the digests with copies (`common.Bitmap`) keeps nearly all texts without copies at home;
    where a corpus fills it, their texts move too, and the result is the same.
    """
    several = common.written(groups.filter("n > 1").select("sha"), "dedup-several")
    held = common.Bitmap(several, "sha", several.count())
    text = docs.select(normalised(common.text_of()).alias("norm")).withColumn("sha", F.sha2("norm", 256))
    same = text.filter(held.maybe("sha")).groupBy("sha").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    return same.filter("least <> greatest").count()


def buckets_for(snapshot: int, incoming: int) -> int:
    """Buckets that hold about BUCKET_KEYS digests of the larger side, so that one task meets no more however the rows are split."""
    return max(1, max(snapshot, incoming) // BUCKET_KEYS)


def deduplicated(docs: DataFrame, split: Column | None = None, check_bytes: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    `split` says which rows belong to the snapshot (by default the lower half of the range of ids), the others are the new batch.
    """
    keyed = common.written(digests(docs), "dedup-digests")
    low, high, total = keyed.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    older = split if split is not None else F.coalesce(F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    old = grouped(keyed.filter(older))
    buckets = buckets_for(old.count(), keyed.filter(~older).count())
    held, filters = snapshot(old, buckets)
    new = common.written(screened(grouped(keyed.filter(~older)), filters, buckets), "dedup-screened")
    groups = common.written(merged(held, new), "dedup-groups")
    if check_bytes and (bad := unequal(docs, groups)):
        raise ValueError(f"{bad} digests stand for several texts")
    several = groups.filter("n > 1")
    x = common.hot_lookup(keyed, several, "sha", "n", total, F.xxhash64("doc_id"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return x.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.tidied(lambda: deduplicated(common.documents(spark, sf_dir)))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
