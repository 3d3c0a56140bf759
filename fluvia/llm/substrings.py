"""Substring deduplication: repeated lines, repeated windows of words, and runs of repeated units of lines.

Three rules give spans, and `repeated_spans` merges them. The occurrence with the smallest (doc_id, place) stays in each:

1. Lines. A whole line that occurs before is removed, whatever its length (letters lower-case, white space one space).
2. Windows. A word is a run without white space and punctuation. A window of RUN_WORDS words that occurs before is removed, wherever it
   begins in a line, unless it overlaps its own first occurrence. So a copied passage of RUN_WORDS words goes whole, to the word.
3. Runs. A line is cut at its punctuation into units; a run of repeated units that covers RUN_WORDS words is removed. A piece of fewer than
   MIN_WORDS words belongs to the run only where it follows the same unit before too, so text that differs stays.

Only what may occur twice leaves its task: units, lines and grams are counted once by 64 bits of their digests, and a bitmap of fixed size
says which are met again; where a corpus fills it more rows travel, and the result is the same. A window is named by its least hash of GRAM words (its
gram) and a digest. Neighbouring windows with the same gram are a region, at most GRAMS of them. Regions travel, not windows: a region that equals
an earlier one is judged whole; where a gram has regions of several kinds, which is at the ends of passages and around edits, the windows
of the first region of each kind are counted one by one. Digests have 128 bits (lines, units) and 96 bits (windows); texts are not compared again.

Edge cases: null or empty text has no spans, nor has a line without words; a null doc_id ranks first; rows that share a doc_id, or have
none, are documents of their own, in the order of a hash of their texts, so later copies lose what the first keeps; very long texts are used
whole; an empty table gives an empty result; extra columns of any name are kept by `cleaned` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import give_back, mix64, slices
from fluvia.llm.ngram_join import _power_tables

MIN_WORDS, RUN_WORDS = 4, 25
#: Words of the hashes that stand for a window, and how many of them a window has.
GRAM = 9
GRAMS = RUN_WORDS - GRAM + 1
#: Characters hashed at a time (more for a longer text).
CHARS = 1 << 18
_MARKS = ".,;:!?"
_LOW = np.arange(0x110000, dtype=np.uint32)
_LOW[:0x20000] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x20000)]
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[:0x20000] = [chr(c).isspace() for c in range(0x20000)]
_SEPARATES = np.zeros(0x110000, dtype=bool)
_SEPARATES[[ord(c) for c in _MARKS + "\n"]] = True
_GAP = _SPACE | _SEPARATES


class _Words:
    """The words of texts, as the runs of characters that are not in `gap`: text, begin and end in the whole, and hash of each. Letters count as
    lower-case."""

    def __init__(self, texts: list[str], gap: np.ndarray = _GAP):
        self.data = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        inside = np.concatenate([[False], ~gap[self.data], [False]])
        self.begin, self.end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.n = len(self.begin)
        self.up, self.down = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([_ZERO, np.cumsum((_LOW[self.data].astype(np.uint64) + np.uint64(1)) * self.up[: len(self.data)], dtype=np.uint64)])
            self.h = mix64((total[self.end] - total[self.begin]) * self.down[self.begin] + (self.end - self.begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.text = np.searchsorted(self.base, self.begin, side="right") - 1
        self.first = np.searchsorted(self.begin, self.base)

    def sums(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([_ZERO, np.cumsum(h * self.up[: self.n], dtype=np.uint64)])

    def digests(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """128-bit digests of the words from a to before b, as two columns."""
        out = np.empty((len(a), 2), dtype="<u8")
        with np.errstate(over="ignore"):
            for i, h in enumerate((self.h, mix64(self.h ^ np.uint64(0x5851F42D4C957F2D)))):
                t = self.sums(h)
                out[:, i] = mix64((t[b] - t[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + salt.astype(np.uint64))
        return out


_ZERO = np.zeros(1, dtype=np.uint64)


def _fixed(x: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    return np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])


def unit_table(texts: list[str]) -> tuple:
    """text, digest, number among the digested units of the text, start, end, words before, words.

    A line is cut at its marks into pieces; one with words enough is a unit. A line with words enough, but none of whose pieces has, is one
    unit. The digest of a shorter piece includes all back to the last unit; those before the first unit have none.
    """
    w = _Words(texts)
    cut, line = np.cumsum(_SEPARATES[w.data]), np.cumsum(w.data == 10)
    a = np.flatnonzero(_changes(cut[w.begin]))
    b = np.append(a[1:], w.n)[: len(a)]
    # lines of short pieces only
    of = line[w.begin[a]]
    head = np.flatnonzero(_changes(of))
    if len(head):
        most, words = np.maximum.reduceat(b - a, head), np.add.reduceat(b - a, head)
        short = (most < MIN_WORDS) & (words >= MIN_WORDS)
        size = np.diff(np.append(head, len(a)))
        keep = ~np.repeat(short, size)
        keep[head] = True
        last = np.append(head[1:], len(a)) - 1
        b[head[short]] = b[last[short]]
        a, b = a[keep], b[keep]
    text, i = w.text[a], np.arange(len(a))
    whole = b - a >= MIN_WORDS
    since = np.maximum.accumulate(np.where(whole, i, -1))
    known = (since >= 0) & (text[since] == text)
    a, b, text, i, since = a[known], b[known], text[known], i[known], since[known]
    source = a[np.searchsorted(i, since)]  # a piece's last unit is among the known
    digest = w.digests(source, b, i - since)
    number = np.arange(len(a)) - np.searchsorted(text, text)
    return text, digest, number, w.begin[a] - w.base[text], w.end[b - 1] - w.base[text], a - w.first[text], b - a


def units_of(text: str) -> list[tuple[bytes, int, int, int, int, int]]:
    """(digest, number among digested units, start, end, words before, words) of the digested units of a text."""
    _, digest, *rest = unit_table([text])
    return list(zip((d.tobytes() for d in digest), *(c.tolist() for c in rest), strict=True))


def line_table(texts: list[str]) -> tuple:
    """text, digest, start, end, words before, words before its end of the lines with words."""
    w, t = _Words(texts), _Words(texts, _SPACE)
    line = np.cumsum(t.data == 10)
    a = np.flatnonzero(_changes(line[t.begin]))
    b = np.append(a[1:], t.n)[: len(a)]
    start, end = t.begin[a], t.end[b - 1]
    before, upto = np.searchsorted(w.begin, start), np.searchsorted(w.begin, end)
    some = upto > before
    a, b, start, end, before, upto = (c[some] for c in (a, b, start, end, before, upto))
    text = t.text[a]
    return text, t.digests(a, b, np.zeros(len(a))), start - t.base[text], end - t.base[text], before - w.first[text], upto - w.first[text]


class _Twice:
    """Which units, lines and grams may occur twice in the corpus, by a bitmap of fixed size over the first 64 bits of their digests: false
    means surely once. All three are counted in one pass."""

    def __init__(self, docs: DataFrame):
        def run(batches):
            for _, text in slices(batches, ["doc_id", "text"], CHARS):
                found = [unit_table(text)[1][:, 0].view("<i8"), line_table(text)[1][:, 0].view("<i8")]
                if (x := windows_of(text)) and len(x[0]):
                    found.append(x[4][_regions_of(x)])
                yield pa.record_batch([pa.array(np.concatenate(found))], names=["h"])
            give_back()

        some = docs.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
        some = common.written(some, "substring-twice")
        held = _Held(some, "h", some.count())
        self.words, self.bits = held.words, held.bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        k = h & (self.bits - 1)
        return (self.words.value[k // 32] >> (k % 32).astype(np.uint32) & 1).astype(bool)


def _pieces(docs: DataFrame, twice: _Twice) -> DataFrame:
    """line (whether it is one, or a unit), digest, doc_id, unit, start, end, from, to: the units and lines that may occur twice."""

    def run(batches):
        for key, text in slices(batches, ["doc_id", "text"], CHARS):
            docs_ = np.array(key, dtype=np.int64)
            which, digest, unit, start, end, before, words = unit_table(text)
            u = (which, digest, unit, start, end, before, before + words)
            which, digest, *rest = line_table(text)
            for line, (which, digest, unit, *rest) in ((False, u), (True, (which, digest, np.zeros(len(which)), *rest))):
                keep = twice.holds(digest[:, 0].view("<i8"))
                yield pa.record_batch([pa.array(np.full(int(keep.sum()), line)), _fixed(digest[keep], 16), pa.array(docs_[which[keep]]), *(pa.array(c[keep].astype(np.int32)) for c in (unit, *rest))], names=["line", "digest", "doc_id", "unit", "start", "end", "from", "to"])
        give_back()

    return docs.mapInArrow(run, "line boolean, digest binary, doc_id long, unit int, start int, end int, from int, to int")


def _runs(pieces: DataFrame) -> DataFrame:
    """doc_id, start, end, from, to, first: runs of repeated units that cover RUN_WORDS words."""
    x = pieces.filter("NOT line").select("digest", "doc_id", "unit", "start", "end", F.col("from").alias("before"), (F.col("to") - F.col("from")).alias("words"))
    first = x.groupBy("digest").agg(F.min(F.struct("doc_id", "unit", "before")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = common.written(first, "substring-repeats")
    found = common.hot_lookup(x, first, "digest", "n", x.count(), F.concat_ws(":", "doc_id", "unit", "start"))
    found = found.filter("first IS NOT NULL AND (first.doc_id <> doc_id OR first.unit <> unit)")
    w = Window.partitionBy("doc_id").orderBy("unit", "start")
    found = found.withColumn("run", F.col("unit") - F.row_number().over(w))
    runs = found.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("before").alias("from"), F.max(F.col("before") + F.col("words")).alias("to"), F.min_by("first", "unit").alias("first"))
    return runs.filter(F.col("to") - F.col("from") >= RUN_WORDS).drop("run")


class _Rows:
    """The rows of a table as documents of their own: `docs` (doc_id: a number for each row; text) and the way back to its doc_id."""

    def __init__(self, docs: DataFrame):
        self.all, self.name, self.same = common.with_row_ids(docs, nulls_first=True)
        self.docs = self.all.select(common.column(self.name).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")

    def real(self, x: DataFrame, *names: str) -> DataFrame:
        """`x` with the numbers in `names` replaced by the doc_id of their rows."""
        for c in () if self.same else names:
            back = self.all.select(common.column(self.name).alias("_n"), F.col("doc_id").cast("long").alias("_d"))
            x = x.join(back, F.col(c) == F.col("_n"), "left").withColumn(c, F.col("_d")).drop("_n", "_d")
        return x


def _long(c: str):
    return F.col(c).cast("long")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, keep_doc_id, keep_unit: the runs of units to remove and where the first unit of each stays."""
    rows = _Rows(docs)
    n = (F.col("to") - F.col("from")).cast("long").alias("n_words")
    x = _runs(common.written(_pieces(rows.docs, _Twice(rows.docs)), "substring-pieces")).select("doc_id", _long("start").alias("start"), _long("end").alias("end"), n, F.col("first.doc_id").alias("keep_doc_id"), F.col("first.unit").cast("long").alias("keep_unit"))
    return rows.real(x, "doc_id", "keep_doc_id")


def windows_of(texts: list[str]) -> tuple[np.ndarray, ...] | None:
    """Of all windows of RUN_WORDS words: text, first word, start, end, gram (least hash of GRAM words), digest (32 bits more)."""
    w = _Words(texts)
    n, begin, end, base, h, down = w.n, w.begin, w.end, w.base, w.h, w.down
    if n < RUN_WORDS:
        return None
    with np.errstate(over="ignore"):

        def rolled(h: np.ndarray, k: int) -> np.ndarray:
            t = w.sums(h)
            return mix64((t[k:] - t[:-k]) * down[: n - k + 1] + np.uint64(k))

        least, width = rolled(h, GRAM), 1
        while width < GRAMS:
            step = min(width, GRAMS - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        digest = (rolled(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), RUN_WORDS) >> np.uint64(32)).astype("<u4")
    doc = w.text
    at = np.flatnonzero(doc[: n - RUN_WORDS + 1] == doc[RUN_WORDS - 1 :])
    d = doc[at]
    return d, at - w.first[d], begin[at] - base[d], end[at + RUN_WORDS - 1] - base[d], least[at].view(np.int64), digest[at]


def _regions_of(x: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first window of each region: where the text or the gram changes, and after each GRAMS windows with one gram."""
    new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[4][1:] != x[4][:-1])])
    i = np.arange(len(new))
    return np.flatnonzero((i - np.maximum.accumulate(np.where(new, i, 0))) % GRAMS == 0)


class _Held(common.Bitmap):
    """By the low bits of a value that is a hash already."""

    def _at(self, column: str):
        return F.pmod(F.col(column), F.lit(self.bits))


def _regions(docs: DataFrame, twice: _Twice) -> DataFrame:
    """gram, region (gram and digest of the region), doc_id, from, to, start, end, near, windows (digests, starts and ends of its windows): the
    regions whose gram may occur twice. `near` ones overlap an equal region of their document."""

    def run(batches):
        for key, text in slices(batches, ["doc_id", "text"], CHARS):
            if not (x := windows_of(text)) or not len(x[0]):
                continue
            d, at, start, end, gram, digest = x
            first = _regions_of(x)
            last = np.append(first[1:], len(d))
            keep = twice.holds(gram[first])
            first, last = first[keep], last[keep]
            if not len(first):
                continue
            table = np.stack([digest, start.astype("<u4"), end.astype("<u4")])
            parts = [np.ascontiguousarray(table[:, a:b]).tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            g = np.ascontiguousarray(gram[first]).astype("<i8")
            region = np.empty((len(g), 2), dtype="<i8")
            region[:, 0] = g
            region[:, 1] = np.frombuffer(b"".join(xxhash.xxh3_64_digest(p[: len(p) // 3]) for p in parts), "<i8")
            order = np.lexsort((at[first], region[:, 1], g, d[first]))
            o, p = order[1:], order[:-1]
            near = np.zeros(len(g), dtype=bool)
            near[o] = (d[first[o]] == d[first[p]]) & (region[o] == region[p]).all(axis=1) & (at[first[o]] - at[first[p]] < RUN_WORDS)
            yield pa.record_batch([_fixed(g, 8), _fixed(region, 16), pa.array(np.array(key, dtype=np.int64)[d[first]]), *(pa.array(c.astype(np.int32)) for c in (at[first], at[last - 1] + RUN_WORDS, start[first], end[last - 1])), pa.array(near), pa.array(parts, pa.binary())], names=["gram", "region", "doc_id", "from", "to", "start", "end", "near", "windows"])
        give_back()

    return docs.mapInArrow(run, "gram binary, region binary, doc_id long, from int, to int, start int, end int, near boolean, windows binary")


def _windows(batches):
    """The windows of regions, one by one."""
    for b in batches:
        grams, docs, at, parts = (b.column(c).to_pylist() for c in ("gram", "doc_id", "from", "windows"))
        if not parts:
            continue
        tables = [np.frombuffer(p, "<u4").reshape(3, -1) for p in parts]
        sizes = np.array([t.shape[1] for t in tables])
        digest, start, end = np.concatenate(tables, axis=1)
        which = np.repeat(np.arange(len(sizes)), sizes)
        first = np.array(at)[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        name = np.empty((len(which), 3), dtype="<u4")
        name[:, :2] = np.frombuffer(b"".join(grams), "<u4").reshape(-1, 2)[which]
        name[:, 2] = digest
        yield pa.record_batch([_fixed(name, 12), pa.array(np.array(docs)[which]), *(pa.array(c.astype(np.int32)) for c in (start, end, first, first + RUN_WORDS))], names=["digest", "doc_id", "start", "end", "from", "to"])


def _first_places(x: DataFrame, key: str, name: str) -> DataFrame:
    """key, n, first (the earliest place): the keys of several places."""
    place = F.struct("doc_id", "from")
    first = x.groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    return common.written(first.filter("first <> last").drop("last"), f"substring-{name}-first")


def _later(x: DataFrame, key: str, first: DataFrame, words: str) -> DataFrame:
    """The rows whose key has an earlier row, `words` words long, that they do not overlap, and `first`, its place."""
    found = common.hot_lookup(x, first, key, "n", x.count(), F.concat_ws(":", "doc_id", "from"))
    return found.filter(f"first IS NOT NULL AND (first.doc_id <> doc_id OR `from` >= first.`from` + ({words}))")


def _repeated_lines(pieces: DataFrame) -> DataFrame:
    x = pieces.filter("line").drop("line", "unit")
    return _later(x, "digest", _first_places(x, "digest", "lines"), "`to` - `from`")


def _repeated_windows(docs: DataFrame, twice: _Twice) -> list[DataFrame]:
    """Spans of whole regions that equal an earlier one; and of single windows, of one region of each kind, where a gram has several kinds."""
    x = common.written(_regions(docs, twice), "substring-regions")
    place = F.struct("doc_id", "from")
    kinds = x.groupBy("gram", "region").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.min_by("windows", place).alias("windows"))
    kinds = common.written(kinds, "substring-region-kinds")
    alike = _later(x.select("region", "doc_id", "from", "to", "start", "end"), "region", kinds.filter("first <> last").select("region", "first", "n"), str(RUN_WORDS))
    mixed = common.written(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "substring-mixed")
    one = kinds.select("gram", F.col("first.doc_id").alias("doc_id"), F.col("first.from").alias("from"), "windows")
    # regions that overlap their own first are not judged above, but their windows may stand elsewhere before
    each = one.unionByName(x.filter("near").select("gram", "doc_id", "from", "windows"))
    each = common.hot_lookup(each, mixed, "gram", "kinds", kinds.count(), F.concat_ws(":", "doc_id", "from")).filter("kinds IS NOT NULL")
    single = common.written(each.mapInArrow(_windows, "digest binary, doc_id long, start int, end int, from int, to int"), "substring-windows")
    return [alike, _later(single, "digest", _first_places(single, "digest", "windows"), str(RUN_WORDS))]


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, span, start, end, from, to, keep: the spans of all three rules, merged where they touch. Each rule's tables go before the
    next begins."""
    spark, kept, found = docs.sparkSession, [], []
    cols = ["doc_id", "start", "end", "from", "to", "keep_doc_id", "keep_word"]

    def done(x: DataFrame, word: str, name: str) -> DataFrame:
        kept.append(out := common.written(x.withColumn("keep_doc_id", F.col("first.doc_id")).withColumn("keep_word", F.col(f"first.{word}")).select(*cols), f"substring-{name}"))
        return out

    with common.passing_tables(spark, kept):
        twice = _Twice(docs)
        pieces = common.written(_pieces(docs, twice), "substring-pieces", ["line"])
        found += [done(_runs(pieces), "before", "runs"), done(_repeated_lines(pieces), "from", "repeated-lines")]
    with common.passing_tables(spark, kept):
        found += [done(y, "from", "repeated-windows") for y in _repeated_windows(docs, twice)]
    x = found[0]
    for y in found[1:]:
        x = x.unionByName(y)
    order = Window.partitionBy("doc_id").orderBy("from", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("new", F.when(F.col("from") <= reached, 0).otherwise(1)).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.min(F.struct("from", "keep_doc_id", "keep_word"))
    return x.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("from")).alias("n_words"), keep.alias("keep"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, keep_doc_id, keep_word: the spans to remove, merged where they touch, and where the first words of
    each stand before (the document and the number of the word there)."""
    rows = _Rows(docs)
    x = _spans(rows.docs)
    x = x.select("doc_id", *(_long(c).alias(c) for c in ("start", "end", "n_words")), F.col("keep.keep_doc_id").alias("keep_doc_id"), _long("keep.keep_word").alias("keep_word"))
    return rows.real(x, "doc_id", "keep_doc_id")


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated spans cut out of `text`, row by row, and a last column `removed` (array of the original start and end; a
    column of that name is replaced)."""
    rows = _Rows(docs)
    removed = F.sort_array(F.collect_list(F.struct(_long("start").alias("start"), _long("end").alias("end"))))
    key, gone = common.fresh(rows.all, "span_doc"), common.fresh(rows.all, "span_list")
    spans = _spans(rows.docs).groupBy(F.col("doc_id").alias(key)).agg(removed.alias(gone))
    x = rows.all.join(spans, common.column(rows.name) == common.column(key), "left")
    text, cut = common.column("text"), common.column(gone)
    edges = F.concat(F.array(F.lit(0).cast("long")), cut["end"])
    kept = F.zip_with(edges, F.concat(cut["start"], F.array(F.length(text).cast("long"))), lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    x = x.withColumn("text", F.when(cut.isNull(), text).otherwise(F.array_join(kept, "")))
    return x.select(*(common.column(c) for c in docs.columns if c.lower() != "removed"), cut.alias("removed"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.documents(spark, sf_dir))
