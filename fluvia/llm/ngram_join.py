"""N-gram Jaccard self-join by vertical partitioning.

A text's set is its distinct five-word shingles, hashed to 64 bits. Texts with one set are one node, named by 128 bits. The global n-gram
order is (number of sets that hold it, hash): rare n-grams first.

1. Frequencies. N-grams are dealt to hash ranges sized by the input and counted there; each text learns only how many of its n-grams
   others hold too. A set that links shares at least 0.75 n of its n with one other set, so only texts that share as many
   go on. N-grams in more than one in HOT_TOKENS of all places (fewer than HOT_TOKENS, by counting) are named by a broadcast and never dealt.
2. Order. The n-grams of those sets are counted once more, among themselves, and sorted into the global order.
3. Candidates. By prefix filtering, two sets that link share an n-gram among their n - ceil(0.75 n) + 1 first ones: the sets that have an n-gram
   in their prefixes are a block. In rounds, each component in a block is tried against the block's largest by one pair of
   representatives, until no round links anything; then the pairs that lie across components, with the length and position
   filters. Pairs within a component need no test.
4. Verification, in each round. The order is cut by quantiles into SEGMENTS contiguous ranges, the vertical fragments. Each counts the partial
   overlap of a pair's segments, and the counts are summed per pair and compared with the threshold exactly. No pair is tested twice.

Edge cases: null or empty text, and text without words, has an empty set and links with nothing; with fewer than five words
the whole sequence is one shingle; repeated rows link with each other; rows with null doc_id keep a null id and are no
one's representative unless alone; very long texts are used whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import give_back, mix64, slices

WORDS = 5
#: Jaccard similarity at least HITS / OF.
HITS, OF = 75, 100
#: N-grams counted at a time, least count that a task reports, and the most hot n-grams (8 bytes each are broadcast).
COUNTED, HEAVY, HOT_TOKENS = 1 << 22, 32, 1 << 17
#: An n-gram of fewer places is never hot.
LEAST_HOT = 1000
#: N-grams of a hash range, about; n-grams packed into one set of rows, at least and at most.
RANGE, PACK, MOST_PACK = 1 << 21, 1 << 18, 1 << 22
#: Vertical fragments of the order; heads of a pair's first set are shared by its pairs in this many buckets.
SEGMENTS, BUCKETS = 4, 256
#: Of the places of n-grams, one in so many is a sample for the cuts of the order.
EVERY = 256
#: Characters hashed at a time (more for a longer text).
CHARS = 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, n.bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, dtype=np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    lengths = np.array([len(r) + 1 for r in raw])
    ends_of = np.cumsum(lengths)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    if not len(data):
        return out
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    begin, end = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    if not len(begin):
        return out
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        h = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        scaled = [h * up[k + 1] for k in range(WORDS)]
        n = len(h)
        five = mix64(sum((scaled[k][k : n - WORDS + 1 + k] for k in range(1, WORDS)), scaled[0][: max(0, n - WORDS + 1)].copy()) + np.uint64(WORDS)) if n >= WORDS else h[:0]
        bounds = np.searchsorted(begin, np.concatenate([[0], ends_of]))
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= WORDS:
                out[i] = np.unique(five[a : b - WORDS + 1])
            elif b > a:
                out[i] = mix64(np.array([sum((int(scaled[k][a + k]) for k in range(b - a)), int(b - a)) & (2**64 - 1)], dtype=np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - -(-HITS * n // OF) + 1



def node_of(s: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# --- nodes and hot n-grams ---------------------------------------------------------------------------------------

NAMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("token", pa.int64()), ("times", pa.int64())])


def _named(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, node), and the n-grams that a task met HEAVY times (token, times)."""

    def heavy(held: list[np.ndarray]):
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= HEAVY
        if k := int(often.sum()):
            none = pa.nulls(k, pa.int64())
            yield pa.record_batch([none, none, pa.nulls(k, pa.binary()), pa.array(tokens[often].view(np.int64)), pa.array(times[often])], schema=NAMED)

    def run(batches):
        held, size = [], 0
        for key, text in slices(batches, ["doc_id", "text"], CHARS, 256):
            sets = shingle_sets(text)
            yield _batch(NAMED, [(doc, len(s), node_of(s) if len(s) else None, None, None) for doc, s in zip(key, sets, strict=True)])
            held += sets
            size += sum(map(len, sets))
            if size > COUNTED:
                yield from heavy(held)
                held, size = [], 0
        if size:
            yield from heavy(held)
        held.clear()
        give_back()

    return _plain(docs).mapInArrow(run, "doc_id long, n long, node binary, token long, times long")


# --- frequencies by hash range -----------------------------------------------------------------------------------

#: Rows of n-grams of a pack of sets (`part`): `doc` says of which set of the pack each is. A row with `ref` lists the sets of the pack.
DEALT = "range int, part long, doc binary, token binary, freq binary, ref binary, n binary"
_DEALT = pa.schema([("range", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in ("doc", "token", "freq", "ref", "n"))])


def _deal(sets, ranges: int, hot: tuple[np.ndarray, np.ndarray], whole: bool):
    """Packs of sets (ref, n-grams) as rows of DEALT. Hot n-grams are left out, as their frequency is known: the row of the pack has them.

    `whole` sends 64 bits of an n-gram and not 32, where a collision within a range only costs a comparison.
    """
    limit, number = min(MOST_PACK, max(PACK, 64 * ranges)), 0
    task = TaskContext.get().partitionId() << 32
    held: list[tuple[bytes, np.ndarray]] = []
    size = 0

    def pack():
        sizes = np.array([len(s) for _, s in held])
        h = np.concatenate([s for _, s in held])
        doc = np.repeat(np.arange(len(held), dtype="<u2"), sizes)
        own, mine, f = np.zeros(0, dtype="<u2"), h[:0], np.zeros(0, dtype="<u4")
        if len(hot[0]):
            k = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
            known = hot[0][k] == h
            own, mine, f = doc[known], h[known], hot[1][k[known]]
            doc, h = doc[~known], h[~known]
        if not whole and len(own):
            own, f = (x.astype(t) for x, t in zip(np.unique(own, return_counts=True), ("<u2", "<u4"), strict=True))
        part = task + number
        rows = [(-1 - part % ranges, part, own.tobytes(), mine.tobytes() if whole else None, f.tobytes(), b"".join(r for r, _ in held), sizes.astype("<u4").tobytes())]
        at = ((h >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[order], np.arange(ranges + 1))
        kind = "<u8" if whole else "<u4"
        for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            o = order[cut[r] : cut[r + 1]]
            rows.append((r, part, doc[o].tobytes(), h[o].astype(kind).tobytes(), None, None, None))
        return _batch(_DEALT, rows)

    for ref, s in sets:
        held.append((ref, s))
        size += len(s)
        if size > limit or len(held) == 65_535:
            yield pack()
            held, size, number = [], 0, number + 1
    if held:
        yield pack()


def _count_ranges(dealt: DataFrame, partitions: int, whole: bool) -> DataFrame:
    """In each range, the n-grams of several sets: for a pack, `doc` and `freq` by n-gram (whole), or `doc` and how many it has."""

    def flush(rows):
        kind = "<u8" if whole else "<u4"
        tokens = [np.frombuffer(r[2], kind) for r in rows]
        _, inverse, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        freq, at, out = np.minimum(times, 2**32 - 1).astype("<u4")[inverse], 0, []
        for (part, doc, token), t in zip(rows, tokens, strict=True):
            f, d = freq[at : at + len(t)], np.frombuffer(doc, "<u2")
            at += len(t)
            several = f > 1
            if several.any():
                if whole:
                    out.append((0, part, d[several].tobytes(), t[several].tobytes(), f[several].tobytes(), None, None))
                else:
                    which, m = np.unique(d[several], return_counts=True)
                    out.append((0, part, which.tobytes(), None, m.astype("<u4").tobytes(), None, None))
        if out:
            yield _batch(_DEALT, out)

    def run(batches):
        last, rows = None, []
        for b in batches:
            through = []
            for r in zip(*(b.column(c).to_pylist() for c in _DEALT.names), strict=True):
                if r[0] < 0:
                    through.append(r)
                    continue
                if r[0] != last:
                    if rows:
                        yield from flush(rows)
                    last, rows = r[0], []
                rows.append(r[1:4])
            if through:
                yield _batch(_DEALT, through)
        if rows:
            yield from flush(rows)

    return dealt.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(run, DEALT)


def _by_pack(counted: DataFrame, partitions: int, finish, schema: str) -> DataFrame:
    """`finish` gets the sets of each pack (ref, n) and its rows (doc, token, freq), and gives record batches."""

    def run(batches):
        last, rows, sets = None, [], None
        for b in batches:
            for _, part, doc, token, freq, ref, n in zip(*(b.column(c).to_pylist() for c in _DEALT.names), strict=True):
                if part != last:
                    if rows:
                        yield from finish(sets, rows)
                    last, rows = part, []
                if ref is not None:
                    sets = (ref, np.frombuffer(n, "<u4").astype(np.int64))
                rows.append((doc, token, freq))
        if rows:
            yield from finish(sets, rows)

    return counted.repartition(partitions, "part").sortWithinPartitions("part", F.col("ref").isNull()).mapInArrow(run, schema)


def _hot(first: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot n-grams, sorted, and how often each was met; fewer than HOT_TOKENS, since each has that share of all places."""
    times = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    rows = times.filter(F.col("times") >= max(LEAST_HOT, total / HOT_TOKENS)).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(rows.column("times").to_numpy()[order], 2**32 - 1).astype("<u4")


def _sharing(docs: DataFrame, hot, frequent, ranges: int, partitions: int) -> DataFrame:
    """node: the sets that share at least 0.75 of their n-grams with others (or with copies of themselves)."""

    def run(batches):
        def sets():
            seen: set[bytes] = set()
            often = frequent.value
            for key, text in slices(batches, ["doc_id", "text"], CHARS, 256):
                for doc, s in zip(key, shingle_sets(text), strict=True):
                    if len(s) and (node := node_of(s)) not in seen and often.get(node, doc) == doc:
                        if len(seen) < 20_000:  # only spares work: a copy that comes again is counted again
                            seen.add(node)
                        yield node, s

        yield from _deal(sets(), ranges, hot.value, False)
        give_back()

    def finish(sets, rows):
        ref, n = sets
        shared = np.zeros(len(n), dtype=np.int64)
        for doc, _, m in rows:
            shared[np.frombuffer(doc, "<u2")] += np.frombuffer(m, "<u4")
        yield pa.record_batch([pa.array([ref[16 * i : 16 * i + 16] for i in np.flatnonzero(OF * shared >= HITS * n).tolist()], pa.binary())], names=["node"])

    dealt = _plain(docs).mapInArrow(run, DEALT)
    return _by_pack(_count_ranges(dealt, partitions, False), partitions, finish, "node binary").distinct()


def _full_sets(docs: DataFrame, nodes: DataFrame, sharing: DataFrame) -> DataFrame:
    """sid, node, rep, tokens (sorted, 64 bits each) of the sets in `sharing`; texts that a bitmap clears are not hashed again."""
    wanted = common.written(sharing.join(nodes, "node").select("node", "rep"), "ngram-sharing")
    keep = common.Bitmap(wanted.filter("rep IS NOT NULL"), "rep", wanted.count())

    def run(batches):
        for _, text in slices(batches, ["doc_id", "text"], CHARS, 256):
            if rows := [(node_of(s), s.tobytes()) for s in shingle_sets(text) if len(s)]:
                yield _batch(schema, rows)

    schema = pa.schema([("node", pa.binary()), ("tokens", pa.binary())])
    some = _plain(docs).filter(F.col("doc_id").isNull() | keep.maybe("doc_id")).mapInArrow(run, "node binary, tokens binary")
    once = some.groupBy("node").agg(F.first("tokens").alias("tokens"))  # all the same
    x = once.join(wanted.hint("merge"), "node")
    return common.written(x.select(F.monotonically_increasing_id().alias("sid"), "node", "rep", "tokens"), "ngram-sets")


# --- the global order --------------------------------------------------------------------------------------------


def _key(token: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Places in the global order: by frequency, then by hash."""
    return (np.minimum(freq, 0x7FFF).astype(np.int64) << np.int64(48)) | (token >> np.uint64(16)).astype(np.int64)


def _ordered(sets: DataFrame, hot, ranges: int, partitions: int) -> DataFrame:
    """sid, n, k, tokens: the k n-grams that other sets of `sets` hold too, in the global order; keys: their places in it."""

    def run(batches):
        def each():
            for b in batches:
                for sid, tokens in zip(b.column("sid").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                    yield sid.to_bytes(8, "little"), np.frombuffer(tokens, "<u8")

        yield from _deal(each(), ranges, hot.value, True)

    def finish(sets, rows):
        sids, n = np.frombuffer(sets[0], "<i8"), sets[1]
        doc, token, freq = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(("<u2", "<u8", "<u4")))
        key = _key(token, freq)
        order = np.lexsort((token, key, doc))
        doc, token, key = doc[order], token[order], key[order]
        cut = np.searchsorted(doc, np.arange(len(n) + 1))
        out = [(int(sids[i]), int(n[i]), b - a, token[a:b].tobytes(), key[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if OF * (b - a) >= HITS * n[i]]
        if out:
            yield _batch(schema, out)

    i, b = pa.int64(), pa.binary()
    schema = pa.schema([("sid", i), ("n", i), ("k", i), ("tokens", b), ("keys", b)])
    dealt = sets.select("sid", "tokens").mapInArrow(run, DEALT)
    return common.written(_by_pack(_count_ranges(dealt, partitions, True), partitions, finish, "sid long, n long, k long, tokens binary, keys binary"), "ngram-ordered")


def _segments(ordered: DataFrame) -> DataFrame:
    """sid, frag, seg: each set cut where the quantiles of all places cut the order."""

    def sample(batches):
        for b in batches:
            keys = np.concatenate([np.frombuffer(x, "<i8") for x in b.column("keys").to_pylist()] or [np.zeros(0, "<i8")])
            yield pa.record_batch([pa.array(keys[::EVERY])], names=["key"])

    shares = [k / SEGMENTS for k in range(1, SEGMENTS)]
    cuts = ordered.mapInArrow(sample, "key long").agg(F.percentile_approx("key", shares, 1000).alias("cuts")).first()["cuts"]
    cuts = np.array(cuts or [0] * (SEGMENTS - 1), dtype=np.int64)

    def run(batches):
        for b in batches:
            rows = []
            for sid, tokens, keys in zip(b.column("sid").to_pylist(), b.column("tokens").to_pylist(), b.column("keys").to_pylist(), strict=True):
                parts = np.split(np.frombuffer(tokens, "<u8"), np.searchsorted(np.frombuffer(keys, "<i8"), cuts))
                rows += [(sid, f, np.sort(p).tobytes()) for f, p in enumerate(parts) if len(p)]
            if rows:
                yield _batch(schema, rows)

    schema = pa.schema([("sid", pa.int64()), ("frag", pa.int32()), ("seg", pa.binary())])
    return common.written(ordered.mapInArrow(run, "sid long, frag int, seg binary"), "ngram-segments")


def _blocks(ordered: DataFrame) -> DataFrame:
    """token, sid, n, own (n-grams that no other set has), rest (n-grams from this one on): the shared n-grams in the prefix of each set.
    Those with one token are a block."""

    def run(batches):
        for b in batches:
            for sid, n, k, tokens in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "k", "tokens")), strict=True):
                if (m := prefix_length(n) - (n - k)) > 0:
                    t = np.frombuffer(tokens, "<i8")[:m]
                    m = len(t)
                    yield pa.record_batch([pa.array(t), pa.array(np.full(m, sid)), pa.array(np.full(m, n)), pa.array(np.full(m, n - k)), pa.array(k - np.arange(m))], names=["token", "sid", "n", "own", "rest"])

    return common.written(ordered.mapInArrow(run, "token long, sid long, n long, own long, rest long"), "ngram-blocks")


# --- candidates --------------------------------------------------------------------------------------------------


def _may_link(a: str, b: str) -> str:
    """By the sizes of the sets, and by what is left of them from a shared n-gram on."""
    return f"""{OF} * least({a}.n, {b}.n) >= {HITS} * greatest({a}.n, {b}.n)
        AND ({HITS} + {OF}) * least({a}.rest, {b}.rest) >= {HITS} * ({a}.n + {b}.n)"""


def _as_pairs(x: DataFrame, a: str, b: str) -> DataFrame:
    """a < b and the sizes of their sets, once each."""
    turned = F.col(f"{a}.sid") > F.col(f"{b}.sid")
    pick = lambda c, u, v: F.when(turned, F.col(f"{v}.{c}")).otherwise(F.col(f"{u}.{c}"))
    return x.select(pick("sid", a, b).alias("a"), pick("sid", b, a).alias("b"), pick("n", a, b).alias("na"), pick("n", b, a).alias("nb")).distinct()


def _star_pairs(blocks: DataFrame) -> DataFrame:
    """In each block, one set of each component with one of the block's largest component: the sets with the fewest n-grams of their own, as
    an original has fewer than its edited copies and leads all their blocks. A block with a third of all sets is counted before
    it is shuffled, and the join by block is one that the adaptive plan splits."""
    lead = F.min(F.struct("own", "sid", "n", "rest", "label")).alias("lead")
    by = blocks.groupBy("token", "label").agg(F.count("*").alias("m"), lead)
    main = F.max_by("lead", F.struct("m", -F.col("lead.own"), -F.col("lead.sid"))).alias("main")
    mixed = by.groupBy("token").agg(F.count("*").alias("kinds"), main).filter("kinds > 1")
    met = by.join(mixed, "token").filter("main.label <> label")
    return _as_pairs(met.filter(_may_link("lead", "main")), "lead", "main")


#: Sizes of sets fall into bands that grow by this factor.
BAND = 1.1


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def _cross_pairs(blocks: DataFrame) -> DataFrame:
    """The pairs across components in the blocks that still hold several. Sets meet by n-gram and size band: a set is sent to the bands of the
    sizes that what is left of it still allows a partner, so sets that share a passage too short to link them don't meet."""
    mixed = blocks.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    some = blocks.join(mixed, "token", "left_semi")
    some = common.written(some.select("token", F.struct("sid", "n", "rest", "label").alias("s")), "ngram-cross")
    least, most = F.ceil(F.col("s.n") * HITS / OF), F.floor(F.least(F.col("s.n") * OF / HITS, ((HITS + OF) * F.col("s.rest") - HITS * F.col("s.n")) / HITS))
    sent = some.withColumns({"least": F.greatest(least, F.lit(1)), "most": most}).filter("most >= least")
    sent = sent.select("token", "s", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))).alias("band"))
    there = some.withColumn("band", _band(F.col("s.n")))
    met = sent.alias("x").join(there.alias("y").hint("merge"), F.expr("x.token = y.token AND x.band = y.band AND x.s.label < y.s.label"))
    met = met.select(F.col("x.s").alias("s"), F.col("y.s").alias("r"))
    return _as_pairs(met.filter(_may_link("s", "r")), "s", "r")


# --- verification ------------------------------------------------------------------------------------------------


def _linked(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: partial overlaps per fragment, summed per pair.

    `pairs` and `segments` are written tables, so where the pairs are few by their size on disk the segments are not shuffled.
    """
    none = F.lit(None).cast("long")
    x = pairs.withColumn("bucket", F.pmod(F.xxhash64("b"), F.lit(BUCKETS)))
    members = x.select("a", "bucket", "b", "na", "nb", F.col("b").alias("sid"))
    heads = x.select("a", "bucket").distinct().select("a", "bucket", none.alias("b"), none.alias("na"), none.alias("nb"), F.col("a").alias("sid"))
    met = heads.unionByName(members).join(segments, "sid").select("a", "bucket", "frag", "b", "na", "nb", "seg")
    together = met.repartition("a", "bucket", "frag").sortWithinPartitions("a", "bucket", "frag", F.col("b").isNotNull(), "b")

    def count(batches):
        """Each group starts with its head. A pair without a common n-gram in a fragment has no row."""
        at = head = None
        for batch in batches:
            rows = []
            for a, bucket, frag, b, na, nb, seg in zip(*(batch.column(c).to_pylist() for c in ("a", "bucket", "frag", "b", "na", "nb", "seg")), strict=True):
                seg = np.frombuffer(seg, "<u8")
                if b is None:
                    at, head = (a, bucket, frag), seg
                elif at == (a, bucket, frag) and (c := len(np.intersect1d(head, seg, assume_unique=True))):
                    rows.append((a, b, na, nb, c))
            if rows:
                yield _batch(schema, rows)

    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb", "c")])
    partial = together.mapInArrow(count, "a long, b long, na long, nb long, c long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return common.written(summed.filter(f"{OF} * c >= {HITS} * (na + nb - c)").select("a", "b"), "ngram-links")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (sid, label) with the components that `links` between sets join."""
    x = links.join(labels.select(F.col("sid").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("sid").alias("b"), F.col("label").alias("lb")), "b")
    moved = common.components(x.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return common.written(labels.join(moved, "label", "left").select("sid", F.coalesce("to", "label").alias("label")), "ngram-labels")


def _labels(ordered: DataFrame) -> DataFrame:
    """sid, label: the components of the sets; a set that links with no other is its own label."""
    segments, blocks = _segments(ordered), _blocks(ordered)
    labels = common.written(ordered.select("sid", F.col("sid").alias("label")), "ngram-labels")
    tested = None
    while True:
        named = blocks.join(labels, "sid")
        pairs = _star_pairs(named)
        pairs = common.written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        if pairs.isEmpty():
            break
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        links = _linked(segments, pairs)
        if links.isEmpty():
            break
        labels = _joined(labels, links)
    cross = _cross_pairs(named)
    cross = common.written(cross if tested is None else cross.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
    if not cross.isEmpty():
        labels = _joined(labels, _linked(segments, cross))
    return labels


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = common.written(_named(docs), "ngram-nodes")
    each = first.filter("n IS NOT NULL").select("doc_id", "n", "node")
    total, places = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kept: list[DataFrame] = []
    with common.passing_tables(spark, kept):
        kept.append(nodes := common.written(each.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "ngram-groups"))
        ranges = max(4 * partitions, -(-places // RANGE))  # several for a task, so that tasks are even
        hot = spark.sparkContext.broadcast(_hot(first, places))
        # sets with one in HOT_SHARE of all rows: fewer than HOT_SHARE
        often = {bytes(r["node"]): r["rep"] for r in nodes.filter(F.col("size") * common.HOT_SHARE > total).filter("rep IS NOT NULL").toLocalIterator()}
        sharing = common.written(_sharing(docs, hot, spark.sparkContext.broadcast(often), ranges, partitions), "ngram-sharing")
        sets = _full_sets(docs, nodes, sharing)
        labels = _labels(_ordered(sets, hot, ranges, partitions))
        member = labels.join(sets.select("sid", "node", "rep"), "sid")
        least = member.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")).filter("members > 1")
        member = member.join(least, "label").select("node", "component_id")
        full = nodes.join(member, "node", "left").filter("size > 1 OR component_id IS NOT NULL")
        kept.append(full := common.written(full.select("node", "size", F.coalesce("component_id", "rep").alias("component_id")), "ngram-full"))
    x = common.hot_lookup(each, full, "node", "size", total, F.col("doc_id"))
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.tidied(lambda: near_groups(common.documents(spark, sf_dir)))
