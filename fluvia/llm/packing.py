"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing depends only on how many pieces there are of each length. So the plan is made on a histogram of
at most `capacity` counts (its size does not grow with the corpus): lengths fall, a segment tree over the remaining
capacities finds the tightest open bins in logarithmic time, and equal bins are kept as ranges of sequence numbers. The
result is the packing that best-fit decreasing gives on the whole corpus at once, not one per partition.
Pieces are then dealt to the planned places by their rank within their length, which the executors work out from
counts per file; a length that holds a third of all rows is spread over all files.

Edge cases: null or empty text is a piece of one end id; repeated rows are packed once each; an empty table gives an
empty result; null doc_id is kept as it is. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import BATCH, byte_encoder, give_back, slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary, part string, rank long"


class MinTree:
    """Segment tree over remaining capacities 0..n: the smallest one at least x that has open bins."""

    def __init__(self, n: int):
        self.n = 1
        while self.n < n + 1:
            self.n *= 2
        self.any = bytearray(2 * self.n)

    def set(self, i: int, on: bool) -> None:
        i += self.n
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        i = x + self.n
        if x >= self.n:
            return None
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Places for pieces: by length, runs (first rank, first bin, offset), each up to the next run's rank; number of bins."""
    tree, open_bins = MinTree(capacity), defaultdict(list)  # remaining capacity -> ranges [first bin, number)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank, mine = histogram[length], 0, []

        def put(b: int, n: int, room: int, length=length, mine=mine) -> int:
            """Fill n bins with as many pieces as fit, the last one in part; how many pieces were placed."""
            nonlocal left, rank
            m = room // length
            full, over = divmod(min(left, n * m), m)
            for k in range(m):
                here = full + (k < over)
                if here:
                    mine.append((rank, b, capacity - room + k * length))
                    rank, left = rank + here, left - here
            for first, number, rest in ((b, full, room - m * length), (b + full, int(over > 0), room - over * length), (b + full + (over > 0), n - full - (over > 0), room)):
                if number and rest:
                    open_bins[rest].append((first, number))
                    tree.set(rest, True)
            return full + (over > 0)

        while left:
            room = tree.tightest(length)
            if room is None:
                need = -(-left // (capacity // length))
                put(bins, need, capacity)
                bins += need
            else:
                b, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
                put(b, n, room)
        runs[length] = sorted(mine)
    return runs, bins


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document: ids and the end id, cut only if longer than the capacity (the first piece takes the odd
    ids). `part` names the task, `rank` counts the pieces of this length before in it."""

    def run(batches):
        encoder, part, seen = byte_encoder(tokenizer), uuid.uuid4().hex, Counter()
        end, names = np.array([end_id], dtype="<u4").tobytes(), [f.name for f in schema]
        try:
            for key, text in slices(batches, ["doc_id", "text"], *BATCH):
                rows = []
                for doc, ids in zip(key, encoder.ids([t or "" for t in text]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n - (-(-n // capacity) - 1) * capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, k, a, b - a, ids[4 * a : 4 * b], part, seen[b - a]))
                        seen[b - a] += 1
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
        finally:
            give_back(encoder)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.string()), ("rank", pa.int64())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (see `tokenised_pieces`)."""
    counts = pieces.groupBy("part", "length").agg(F.max("rank").alias("top"))
    counts = common.written(counts.select("part", "length", (F.col("top") + 1).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    spark = pieces.sparkSession
    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    x = pieces.drop("ids").join(base.hint("merge"), ["part", "length"])  # it grows with the input: not to be broadcast
    held = spark.sparkContext.broadcast({k: tuple(np.array(c, dtype="int64") for c in zip(*v, strict=True)) for k, v in runs.items()})  # bounded by the capacity

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False) + b.column("before").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), dtype="int64"), np.zeros(len(length), dtype="int64")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, bins, offsets = held.value[int(n)]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at], off[at] = bins[k] + rank[at] - ranks[k], offsets[k]
            keep = [c for c in b.schema.names if c not in ("before", "rank", "part")]
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    kept = [f for f in x.schema.fields if f.name not in ("before", "rank", "part")]
    return x.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, places): the written pieces and doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = common.written(tokenised_pieces(docs, tokenizer, end_id, capacity), "pack-pieces")
    x = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return pieces, pack(x, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_dir

    return best_fit(common.documents(spark, sf_dir), tokenizers_dir.path("byte_bpe_50k.json"))[1]
