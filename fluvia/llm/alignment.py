"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair of ids is in the corpus.

Tokens of both cut a text's bytes; the cuts of both together make segments, and each segment is one overlapping pair of tokens, so a batch of documents is aligned by
merging two sorted lists of ends. A pair of ids is one 64-bit key (A's id above B's). Documents' distinct keys are counted per partition (`numpy.unique`),
the partial counts sorted globally by ranges of the key and summed by runs, and each range is written as one shard: an `.npy` file of sorted keys and one of counts, in the
shared folder. Lookups map the shards into memory and search the sorted keys, so a task holds the pages that it touches and not the table.

Edge cases: null and empty texts, and texts that either tokenizer does not restore to a space and the text, have no tokens (zeros and '') and count in no pair;
repeated rows count as documents of their own; rows with a null doc_id are kept; special tokens' strings in a text are plain text; an empty table gives an empty
result; extra columns are ignored. A long text is cut for the tokenizers where no token can span, never shortened.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common, encoding
from fluvia.llm.encoding import Encoder, Pieces, byte_encoder, give_back, slices

#: Bits of B's id in a key.
LOW = 32
#: Distinct keys that a partition gathers before it emits partial counts.
GATHERED = 1 << 21
#: Partial counts of a shard, about, and the most shards: their list is all that the driver gets.
SHARD_ROWS, MOST_SHARDS = 1 << 22, 4096

_held: dict[tuple, object] = {}


def _once(key: tuple, make):
    if key not in _held:
        _held[key] = make()
    return _held[key]


# --- tokenizers --------------------------------------------------------------------------------------------------

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters of byte-level vocabularies and the bytes that they stand for.
_SHOWN = {c: b for b, c in encoding._ALPHABET.items()}


def bytes_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens stand for none, as they are never given."""
    t = encoding._library(path)
    out = [b""] * (max(t.get_vocab().values()) + 1)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(_SHOWN[c] for c in token) if all(c in _SHOWN for c in token) else b""
    return out


def _pieces(path: str):
    import sentencepiece

    return _once(("sp", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def bytes_b(path: str) -> list[bytes]:
    sp = _pieces(path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(m[1], 16)]) if sp.is_byte(i) and (m := _BYTE.fullmatch(p)) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


#: Where a text can't be cut at each space, and what a cut must not follow: a space, or the mark that the model takes for one.
_ODD = "^ |  |▁"
_SPACE = re.compile(r"(?<=[^ ▁]) ")


def cut_at_spaces(texts: list[str]) -> tuple[pa.Array, None, np.ndarray]:
    """Pieces for a sentencepiece model none of whose pieces holds a space after another character: a text is cut before each space
    that follows one, and the library puts that space back before a piece."""
    whole = pa.array(texts, pa.large_string())
    odd = np.flatnonzero(pc.match_substring_regex(whole, _ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(whole).to_numpy(zero_copy_only=False) == 0))
    if not len(odd):
        lists = pc.split_pattern(whole, " ")
        return lists.flatten(), None, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    parts: list[pa.Array] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    begin = 0
    for k in [*odd.tolist(), len(texts)]:
        if k > begin:
            lists = pc.split_pattern(whole.slice(begin, k - begin), " ")
            parts.append(lists.flatten())
            counts[begin:k] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if k < len(texts):
            cut = _SPACE.split(texts[k]) if texts[k] else []
            parts.append(pa.array(cut, pa.large_string()))
            counts[k] = len(cut)
        begin = k + 1
    return pa.concat_arrays(parts), None, counts


def cut_after_space(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of byte-level BPE of texts that stand after a space and begin with no white space of their own: the first is like any other within."""
    pieces, start, counts = encoding.cut_byte_level(texts)
    first = np.cumsum(counts) - counts
    lone = pc.equal(pieces.take(pa.array(first)), "\n").to_numpy(zero_copy_only=False) if len(first) else np.zeros(0, dtype=bool)
    start[first[~lone]] = False
    return pieces, start, counts


def spaced_arrays(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of a space and each text by a byte-level vocabulary; an empty text has none."""
    usual = byte_encoder(path)
    after = _once(("after space", path), lambda: Encoder(cut_after_space, usual.inner, usual.first))
    plain = [bool(t) and not t[0].isspace() for t in texts]
    own, other = iter(after.arrays([t for t, p in zip(texts, plain, strict=True) if p])), iter(usual.arrays([t and " " + t for t, p in zip(texts, plain, strict=True) if not p]))
    return [next(own) if p else next(other) for p in plain]


def piece_encoder(path: str) -> Encoder:
    def make() -> Encoder:
        sp = _pieces(path)
        if any(" " in b.lstrip(b" ").decode("utf-8", "replace") for b in bytes_b(path)):
            raise ValueError("a piece of this model spans a space")
        space = [sp.piece_to_id("▁")]  # a space at the end of a text, where the library would put none back
        return Encoder(cut_at_spaces, Pieces(lambda p: sp.encode(p, num_threads=1) if p else space))

    return _once(("encoder", path), make)


# --- alignment of a batch ----------------------------------------------------------------------------------------


class Tables:
    """Bytes, lengths and decimal names of two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = bytes_a(path_a), bytes_b(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a, self.b))
        # an id and what follows it: of A the next id of its group or the bar, of B the next id or the end of the group
        self.named = [f"{i}{end}" for t, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends for i in range(len(t))]


def tables(path_a: str, path_b: str) -> Tables:
    return _once(("tables", path_a, path_b), lambda: Tables(path_a, path_b))


def aligned_batch(texts: list[str | None], path_a: str, path_b: str) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, keys (distinct, ascending, 64 bits), times (32 bits) of each text."""
    t = tables(path_a, path_b)
    whole = [x or "" for x in texts]
    ids_a = spaced_arrays(whole, path_a)
    ids_b = piece_encoder(path_b).arrays(whole)
    none = np.zeros(0, dtype=np.uint32)
    for k, x in enumerate(whole):
        raw = (" " + x).encode() if x else b""
        if b"".join(map(t.a.__getitem__, ids_a[k].tolist())) != raw or b"".join(map(t.b.__getitem__, ids_b[k].tolist())) != raw:
            ids_a[k] = ids_b[k] = none
    size_a, size_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([none, *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(t.len_a[a]), np.cumsum(t.len_b[b])
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two sorted runs
    again = np.append(ends[1:] == ends[:-1], False) if len(ends) else np.zeros(0, dtype=bool)
    cuts, both = ends[~again], ends[again]
    at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    # places of documents in tokens, segments and groups; a document ends where tokens of both end
    doc_a, doc_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
    edge = np.append(0, end_a)[doc_a]
    seg, grp = np.searchsorted(cuts, edge, side="right"), np.searchsorted(both, edge, side="right")
    keys = a[at_a] << LOW | b[at_b]

    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    last_a, last_b = both[group_a] == end_a if len(a) else group_a, both[group_b] == end_b if len(b) else group_b
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + len(t.a) * last_a
    order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * len(t.a) + b + len(t.b) * last_b
    names = list(map(t.named.__getitem__, order.tolist()))
    out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times")}
    for k in range(len(whole)):
        own, times = np.unique(keys[seg[k] : seg[k + 1]], return_counts=True)
        n = (int(size_a[k]), int(size_b[k]))
        said = "".join(names[doc_a[k] + doc_b[k] : doc_a[k + 1] + doc_b[k + 1]])[:-1]
        row = (*n, int(grp[k + 1] - grp[k]), int(seg[k + 1] - seg[k]), hashlib.sha256(said.encode()).hexdigest() if n[0] else "", own.astype("<i8").tobytes(), times.astype("<i4").tobytes())
        for column, v in zip(out.values(), row, strict=True):
            column.append(v)
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
_ALIGNED = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ALIGNED of each row."""

    def run(batches):
        try:
            for key, text in slices(batches, ["doc_id", "text"]):
                yield pa.record_batch([pa.array(v, kind) for v, (_, kind) in zip((key, *aligned_batch(text, path_a, path_b).values()), _ALIGNED, strict=True)], names=[n for n, _ in _ALIGNED])
        finally:
            give_back(byte_encoder(path_a))
            give_back(piece_encoder(path_b))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


# --- counts of pairs ---------------------------------------------------------------------------------------------


def partial_counts(documents: DataFrame) -> DataFrame:
    """key, n: documents of a partition that hold the key."""

    def run(batches):
        keys, counts, gathered = [], [], 0

        def summed():
            own, where = np.unique(np.concatenate(keys), return_inverse=True)
            return own, np.bincount(where, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)

        def emit(own, n):
            for k in range(0, len(own), 1 << 16):
                yield pa.record_batch([pa.array(own[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["key", "n"])

        for b in batches:
            x = np.frombuffer(b"".join(v for v in b.column("keys").to_pylist() if v), dtype="<i8")
            own, n = np.unique(x, return_counts=True)
            keys.append(own)
            counts.append(n)
            gathered += len(own)
            if gathered > GATHERED:
                own, n = summed()
                if len(own) > GATHERED // 2:
                    yield from emit(own, n)
                    own, n = own[:0], n[:0]
                keys, counts, gathered = [own], [n], len(own)
        if keys:
            yield from emit(*summed())

    return documents.select("keys").mapInArrow(run, "key long, n long")


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the path there: executors read and write shards without Spark's readers."""
    if urlparse(uri).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return pa.fs.FileSystem.from_uri(uri)


def write_shards(partials: DataFrame, folder: str, shards: int) -> list[tuple[int, int, str]]:
    """Sum the partial counts in sorted ranges, write each as a shard, and list (least key, greatest key, name).

    A task writes under names of its own and a shard counts only when its row is in the list, so a task that is run again leaves
    at most a file that nothing reads.
    """
    store = folder

    def run(batches):
        from pyspark import TaskContext

        keys, counts = [], []
        for b in batches:
            k, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
            if not len(k):
                continue
            own, n = k[begin], np.add.reduceat(n, begin)
            if keys and keys[-1][-1] == own[0]:  # a run goes on across batches
                counts[-1][-1] += n[0]
                own, n = own[1:], n[1:]
            if len(own):
                keys.append(own)
                counts.append(n)
        if not keys:
            return
        fs, path = _store(store)
        name = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}"
        fs.create_dir(path, recursive=True)
        own, n = np.concatenate(keys), np.concatenate(counts)
        for kind, x in (("keys", own), ("counts", n)):
            buffer = io.BytesIO()
            np.save(buffer, x)
            with fs.open_output_stream(f"{path}/{name}.{kind}.npy") as f:
                f.write(buffer.getbuffer())
        yield pa.record_batch([pa.array([own[0]]), pa.array([own[-1]]), pa.array([name])], names=["low", "high", "name"])

    ordered = partials.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return sorted(map(tuple, ordered.mapInArrow(run, "low long, high long, name string").collect()))


class Counts:
    """Counts of keys from shards, by search in sorted arrays mapped into memory. A store that can't be mapped is read shard by shard."""

    def __init__(self, folder: str, shards: list[tuple[int, int, str]]):
        self.folder, self.shards = folder, shards
        self.lows = np.array([s[0] for s in shards], dtype=np.int64)

    def _array(self, name: str, kind: str) -> np.ndarray:
        fs, path = _store(self.folder)
        file = f"{path}/{name}.{kind}.npy"
        if isinstance(fs, pa.fs.LocalFileSystem):
            return _once((file, os.getpid()), lambda: np.load(file, mmap_mode="r"))
        with fs.open_input_file(file) as f:
            return np.load(io.BytesIO(f.read()))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of the ascending keys, all of which are held."""
        out = np.zeros(len(keys), dtype=np.int64)
        bounds = np.append(np.searchsorted(keys, self.lows), len(keys))
        for (_, _, name), begin, end in zip(self.shards, bounds, bounds[1:], strict=False):
            if end > begin:
                out[begin:end] = self._array(name, "counts")[np.searchsorted(self._array(name, "keys"), keys[begin:end])]
        return out

    def best(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of a shard and the highest count of each there."""
        name = self.shards[shard][2]
        keys, counts = self._array(name, "keys"), self._array(name, "counts")
        own, begin = np.unique(keys >> LOW, return_index=True)
        return own, np.maximum.reduceat(counts, begin)


def _best(spark: SparkSession, counts: Counts, n_a: int) -> np.ndarray:
    """The highest count of each A id, over all shards: an array as long as A's vocabulary."""

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in counts.best(k)], names=["a", "best"])

    n = len(counts.shards)
    out = np.zeros(n_a, dtype=np.int64)
    if n:
        found = spark.range(n, numPartitions=n).mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
        for r in found.toLocalIterator():
            out[r["a"]] = r["best"]
    return out


def scored(documents: DataFrame, counts: Counts, best) -> DataFrame:
    """The aligned documents with n_best and count_sum. `best` is a broadcast of `_best`, bounded by A's vocabulary."""

    def run(batches):
        for b in batches:
            held = [np.frombuffer(x or b"", dtype="<i8") for x in b.column("keys").to_pylist()]
            times = np.concatenate([np.zeros(0, dtype="<i4"), *[np.frombuffer(x or b"", dtype="<i4") for x in b.column("times").to_pylist()]]).astype(np.int64)
            keys = np.concatenate([np.zeros(0, dtype=np.int64), *held])
            own, where = np.unique(keys, return_inverse=True)
            n = counts.of(own)
            top = n == best.value[own >> LOW]
            doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
            sums = np.zeros(len(held), dtype=np.int64)
            tops = np.zeros(len(held), dtype=np.int64)
            np.add.at(sums, doc, n[where] * times)
            np.add.at(tops, doc, top[where] * times)
            kept = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.record_batch([*kept, pa.array(tops), pa.array(sums), b.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return documents.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `docs`."""
    spark = docs.sparkSession
    found = common.written(aligned(docs, path_a, path_b), "aligned")
    folder = common.new_path(spark, "pair-shards")
    with common.passing_tables(spark, [found]):
        partials = common.written(partial_counts(found), "pair-counts")
        shards = write_shards(partials, folder, int(min(MOST_SHARDS, max(8, partials.count() // SHARD_ROWS))))
    counts = Counts(folder, shards)
    best = spark.sparkContext.broadcast(_best(spark, counts, len(tables(path_a, path_b).a)))
    return scored(found, counts, best)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_dir

    return alignment(common.documents(spark, sf_dir), tokenizers_dir.path("byte_bpe_50k.json"), tokenizers_dir.path("piece_bpe_32k.model"))
