"""A content-addressed store of token ids.

Format. A gear rolling hash over the ids cuts each document's id stream into chunks at content-defined places, so copies
and shared passages give the same chunks. `files/kind=chunk` holds each distinct chunk once: its SHA-256, its ids as little-endian unsigned
integers of `width` bytes (2 where the vocabulary allows), named by their content. `recipes/` holds, in ascending doc_id
order over its files, each document's id count and list of chunk names with a Merkle root over them. `manifest/` has one row
per recipe file: its place in the order, the number of ids before it, and a Merkle root over its documents' roots.

Reading back checks every chunk against its name and every recipe against its root, and the files' roots against the manifest.

Edge cases: null text counts as empty (only the end id); repeated rows keep one recipe each; an empty table gives empty
files; null doc_id comes first in the order; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import BATCH, give_back, slices, word_encoder

#: Ids in a chunk: least, about the mean, most.
LEAST, MEAN, MOST = 256, 1024, 4096
#: Ids that the rolling hash looks at.
WINDOW = 6
#: Chunk names a task remembers, to send each chunk once; a forgotten one is only sent again.
SEEN = 100_000


def _gear(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a stream may be cut, as the hash of the last WINDOW ids says. In several streams at once the first places of each
    depend on the stream before, but no chunk ends within its first LEAST ids."""
    g = _gear(ids)
    h = np.zeros(len(ids), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, len(ids))):
            h[k:] += g[: len(ids) - k] << np.uint64(k)
    return np.flatnonzero((h >> np.uint64(20)) % np.uint64(MEAN - LEAST) == 0) + 1


def ends(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids that may be cut at `places`."""
    out, last = [], 0
    for m in [*places, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or (m == n and m > last):
            out.append(m)
            last = m
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return ends(marks(ids).tolist(), len(ids))


def merkle(names: list[bytes]) -> bytes:
    """Root over names: pairs are hashed level by level, an odd one moves up."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _staged(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Rows of both kinds from one pass over the texts: chunks (name, payload) and recipes (doc_id, n_tokens, names, root)."""
    kind = f"<u{width}"

    def run(batches):
        encoder, seen = word_encoder(tokenizer), set()
        end = np.array([end_id], dtype="<u4")
        try:
            for key, text in slices(batches, ["doc_id", "text"], *BATCH):
                arrays = encoder.arrays([t or "" for t in text])
                flat = np.concatenate([x for a in arrays for x in (a, end)]).astype(kind)
                last = np.cumsum([len(a) + 1 for a in arrays])
                first = (last - [len(a) + 1 for a in arrays]).tolist()
                places = marks(flat)
                begin, stop = np.searchsorted(places, first, side="right").tolist(), np.searchsorted(places, last).tolist()
                whole, rows = flat.tobytes(), []
                for i, doc in enumerate(key):
                    at = first[i]
                    n, names = int(last[i]) - at, []
                    a = 0
                    for c in ends((places[begin[i] : stop[i]] - at).tolist(), n):
                        part = whole[width * (at + a) : width * (at + c)]
                        a = c
                        names.append(name := hashlib.sha256(part).digest())
                        if name not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(name)
                            rows.append(("chunk", name, part, None, None, None, None))
                    root = merkle(names)
                    rows.append(("recipe", hashlib.sha256(root + str(doc).encode()).digest(), None, doc, n, names, root))
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)
        finally:
            give_back(encoder)

    b = pa.binary()
    schema = pa.schema([("kind", pa.string()), ("name", b), ("payload", b), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.list_(b)), ("root", b)])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "kind string, name binary, payload binary, doc_id long, n_tokens long, names array<binary>, root binary")


def _roots(batches):
    rows: dict[int, list] = {}
    for b in batches:
        for part, doc, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "root")), strict=True):
            r = rows.setdefault(part, [0, 0, []])
            r[0], r[1] = r[0] + 1, r[1] + n
            r[2].append(root)
    yield pa.record_batch(
        [pa.array(list(rows), pa.int32()), pa.array([r[0] for r in rows.values()], pa.int64()), pa.array([r[1] for r in rows.values()], pa.int64()), pa.array([merkle(r[2]) for r in rows.values()], pa.binary())],
        names=["part", "n_docs", "n_tokens", "root"],
    )


RECIPE = "doc_id long, n_tokens long, names array<binary>, root binary, part int"
MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 2, path: str | None = None) -> str:
    """Write the store of `docs` and return its path."""
    spark = docs.sparkSession
    path = path or common.new_path(spark, "id-store")
    staged = _staged(docs, tokenizer, end_id, width)
    # chunks of one name meet in one partition; a task sends a name once, so no name is hot
    same = Window.partitionBy("name").orderBy("kind")
    staged = staged.withColumn("seen", F.row_number().over(same)).filter("kind = 'recipe' OR seen = 1").drop("seen")
    staged.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/files")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/files")
    recipes = staged.filter("kind = 'recipe'").select("doc_id", "n_tokens", "names", "root")
    recipes = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    files = spark.read.schema(RECIPE).parquet(f"{path}/recipes").repartition("part").sortWithinPartitions("part", "doc_id", "root").select("part", "doc_id", "n_tokens", "root")
    files.mapInArrow(_roots, MANIFEST).write.parquet(f"{path}/manifest")
    return path


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/files").filter("kind = 'chunk'").select("name", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, names, root; start counts the ids of all documents before in ascending order."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = manifest.select("part", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("before"))
    x = spark.read.schema(RECIPE).parquet(f"{path}/recipes").join(before, "part")
    w = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    return x.select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).alias("start"), "n_tokens", "names", "root")


_POLY = 0xEDB88320


def _crc_shift(crc: int, n: int) -> int:
    """The CRC-32 register after n zero bytes: steps of powers of two, each a linear map over bits, looked up byte by byte."""
    k = 0
    while n and crc:
        if n & 1:
            a, b, c, d = _power(k)
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
        n >>= 1
        k += 1
    return crc


def _apply(m: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


_maps: list[tuple[int, ...]] = []
_powers: list[tuple[list[int], ...]] = []


def _power(k: int) -> tuple[list[int], ...]:
    """The map of 2**k zero bytes, as a table for each byte of the register."""
    while len(_powers) <= k:
        if not _maps:
            m = (_POLY, *(1 << i for i in range(31)))  # one zero bit; its columns are the images of single bits
            for _ in range(3):
                m = tuple(_apply(m, c) for c in m)  # 2, 4, 8 bits
        else:
            m = tuple(_apply(_maps[-1], c) for c in _maps[-1])
        _maps.append(m)
        _powers.append(tuple([_apply(m, x << shift) for x in range(256)] for shift in (0, 8, 16, 24)))
    return _powers[k]


def combined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from the (crc, bytes) of its parts."""
    crc = 0
    for c, n in parts:
        crc = _crc_shift(crc, n) ^ c
    return crc


def checked_chunks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """name, ids, crc of every chunk in the files; a chunk that does not hash to its name is an error."""

    def run(batches):
        for b in batches:
            names, payloads = b.column("name").to_pylist(), b.column("payload").to_pylist()
            for name, x in zip(names, payloads, strict=True):
                if hashlib.sha256(x).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            crc = [zlib.crc32(np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes()) for x in payloads]
            yield pa.record_batch([b.column("name"), pa.array([len(x) // width for x in payloads], pa.int64()), pa.array(crc, pa.int64())], names=["name", "ids", "crc"])

    return chunks(spark, path).mapInArrow(run, "name binary, ids long, crc long")


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: all chunks are read and verified, each document's CRC-32 is put together
    from those of its chunks, and its recipe is verified against its root."""
    docs = common.written(recipes(spark, path), "store-recipes").withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start"))
    used = docs.select("row", F.posexplode("names").alias("pos", "name"))
    info = checked_chunks(spark, path, width)
    uses = common.written(used.groupBy("name").agg(F.count("*").alias("uses")).join(info, "name"), "store-uses")
    total = used.count()
    found = common.hot_lookup(used, uses, "name", "uses", total, F.concat_ws(":", "row", "pos"))
    parts = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "ids", "crc"))).alias("parts"))

    def run(batches):
        for b in batches:
            out, lists = [], b.column("parts")
            flat = lists.flatten()
            names, ids, crcs = (flat.field(k).to_pylist() for k in ("name", "ids", "crc"))
            at = 0
            for n, root, k in zip(b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), pc.list_value_length(lists).to_pylist(), strict=True):
                mine, sizes, sums = names[at : at + k], ids[at : at + k], crcs[at : at + k]
                at += k
                if None in sums:
                    raise ValueError("a chunk is missing")
                if merkle(mine) != root or sum(sizes) != n:
                    raise ValueError("a recipe does not match its root")
                out.append(combined([(c, 4 * size) for c, size in zip(sums, sizes, strict=True)]))
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    x = docs.select("row", "doc_id", "start", "n_tokens", "root").join(parts, "row")
    return x.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (binary): the documents put together again from their chunks. A chunk of a third of all documents is looked up
    by a broadcast (see `common.hot_lookup`; fewer than 1000 such chunks of at most MOST ids)."""
    docs = common.written(recipes(spark, path), "store-recipes").withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start"))
    used = docs.select("row", F.posexplode("names").alias("pos", "name"))
    uses = used.groupBy("name").agg(F.count("*").alias("uses")).join(chunks(spark, path), "name")
    found = common.hot_lookup(used, uses, "name", "uses", used.count(), F.concat_ws(":", "row", "pos"))
    parts = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts.payload", F.hex), ""))
    return docs.join(parts, "row").select("doc_id", "start", joined.alias("ids"))


def verify_manifest(spark: SparkSession, path: str) -> int:
    """Files whose recipes do not give the root in the manifest."""
    files = spark.read.schema(RECIPE).parquet(f"{path}/recipes").repartition("part").sortWithinPartitions("part", "doc_id", "root").select("part", "doc_id", "n_tokens", "root")
    again = files.mapInArrow(_roots, MANIFEST)
    return again.exceptAll(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).count()


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_dir

    path = write_store(common.documents(spark, sf_dir), tokenizers_dir.path("word_bpe_49k.json"))
    if verify_manifest(spark, path):
        raise ValueError("the manifest does not match the recipes")
    return read_digests(spark, path)
