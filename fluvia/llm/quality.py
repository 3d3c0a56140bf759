"""Quality rules: statistics of a text and a learned decision list, in DataFrame expressions only.

Statistics are column expressions; windows of five words are compared by their 64-bit hashes within one text, so nothing is
exploded or shuffled. The decision list is learned by sequential covering on at most SAMPLE labelled rows (those with the
smallest hashes of their ids): each rule grows as a conjunction of up to MAX_TERMS thresholds on statistics, by FOIL gain on the
growing part, is pruned from its end on the pruning part, has its thresholds centred in the gaps they cut, and is accepted if it is precise enough there; rows it covers leave, and
the next rule is learned. The list is emitted as one ordered conditional expression (CASE WHEN), which Catalyst compiles.

Edge cases: null or empty text has no words, zero statistics and fails the base rule; repeated rows are judged each; labels with null
are not used; with no usable labels (or a single class) the list is empty and only the base rule judges; an empty table gives an
empty result; extra columns are kept by `kept_only` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common

#: The most labelled rows that the list is fitted on.
SAMPLE = 4000
#: Thresholds tried for each statistic, terms in a rule, rules in a list.
CUTS, MAX_TERMS, MAX_RULES = 24, 3, 12
#: A rule must be right on this share of the rows it covers, in the pruning part too, and cover this many rejected rows.
PRECISION, LEAST = 0.95, 5
#: Share of the best gain that a term in a wider gap may have.
NEAR = 0.8

WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


#: Statistics that rules may use, all rates (variety: log of distinct over log of all words), so that a rule behaves alike on texts of any length.
FEATURES = ("repeat_rate", "dup_line_rate", "symbol_rate", "upper_rate", "digit_rate", "mark_rate", "mean_word", "variety", "pipe_rate", "link_rate")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, FEATURES and `_at`.

    `_at` numbers the rows; a filter that uses it stays above these expressions (a filter pushed into them would repeat
    them word by word).
    """
    t, n, g = F.col("t"), F.col("n_words"), F.col("g")
    x = docs.select(*keep, common.text_of().alias("t"))
    trimmed = F.btrim(t, F.lit(WHITE))
    none = F.array().cast("array<long>")
    lines = F.filter(F.split(t, "\n"), lambda v: F.length(F.translate(v, WHITE, "")) > 0)
    x = x.select(
        *keep,
        F.when(trimmed == "", none).otherwise(F.transform(F.split(trimmed, "[ \\t-\\r]+"), lambda w: F.xxhash64(w))).alias("g"),
        F.transform(lines, lambda v: F.xxhash64(v)).alias("lines"),
        F.length(_without(t, WHITE)).cast("long").alias("word_chars"), _count(t, SYMBOLS).alias("n_symbols"), (_count(t, "\n") + 1).alias("n_lines"),
        _count(t, UPPER).alias("n_upper"), _count(t, "0123456789").alias("n_digit"), _count(t, "!?").alias("n_mark"), _count(t, "|").alias("n_pipe"), _count(t, "/@").alias("n_link"),
    )
    rest = ["word_chars", "n_symbols", "n_lines", "n_upper", "n_digit", "n_mark", "n_pipe", "n_link"]
    x = x.select(*keep, *rest, "g", F.size("g").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    rest += ["n_words", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), n.cast("int") - 5), lambda i: F.xxhash64(*[F.get(g, i + k) for k in range(5)]))
    x = x.select(*keep, *rest, F.size(F.array_distinct("g")).cast("long").alias("n_distinct"), F.when(n >= 5, windows).otherwise(none).alias("h"))
    rest += ["n_distinct"]
    # windows found twice: sorted by (hash, place), equal neighbours; most texts have none
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.select(*keep, *rest, F.when(F.size("h") > F.size(F.array_distinct("h")), placed).alias("m"))
    m, s = F.col("m"), F.col("starts")
    twice = F.filter(m, lambda v, k: (F.get(m, k - 1)["h"] == v["h"]) | (F.get(m, k + 1)["h"] == v["h"]))
    x = x.select(*keep, *rest, F.when(m.isNotNull(), F.sort_array(F.transform(twice, lambda v: v["i"]))).alias("starts"))
    covered = F.aggregate(F.transform(s, lambda v, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1) - v, F.lit(5)))), F.lit(0).cast("long"), lambda a, v: a + v)
    x = x.select(*keep, *rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    words, chars = F.greatest(n, F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    return x.select(
        *keep, F.monotonically_increasing_id().alias("_at"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 10) | (100 * F.col("n_repeat_words") > 20 * n)).alias("base_failed"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_rate"),
        (F.col("n_symbols") / chars).alias("symbol_rate"),
        (F.col("n_upper") / chars).alias("upper_rate"),
        (F.col("n_digit") / chars).alias("digit_rate"),
        (F.col("n_mark") / chars).alias("mark_rate"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.log1p(F.col("n_distinct").cast("double")) / F.log1p(words)).alias("variety"),
        (F.col("n_pipe") / words).alias("pipe_rate"),
        (F.col("n_link") / chars).alias("link_rate"),
    )


# --- the decision list -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.cut) == self.above

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    """A conjunction of terms; rows that it covers are rejected with this precision."""

    terms: tuple[Term, ...]
    precision: float

    def covers(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.terms)

    def column(self) -> Column:
        out = self.terms[0].column()
        for t in self.terms[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:.6g}" for t in self.terms)


def _cuts(rows: list[dict], f: str) -> list[tuple[float, float]]:
    """Thresholds with the width of the gap that each cuts, as a share of the range: quantiles and the widest gaps."""
    values = sorted({r[f] for r in rows})
    if len(values) < 2:
        return []
    gaps = sorted(range(len(values) - 1), key=lambda i: (values[i] - values[i + 1], i))[: CUTS // 2]
    places = sorted({i * (len(values) - 1) // CUTS for i in range(CUTS)} | set(gaps))
    return [((values[i] + values[i + 1]) / 2, (values[i + 1] - values[i]) / (values[-1] - values[0])) for i in places]


def _grow(rows: list[dict]) -> list[Term]:
    """Terms by FOIL gain, until no rejected-only conjunction improves; of terms within NEAR of the best gain, the one in
    the widest gap."""
    terms: list[Term] = []
    inside = rows
    while len(terms) < MAX_TERMS:
        bad = sum(r["bad"] for r in inside)
        if not bad or bad == len(inside):
            break
        tried: list[tuple[float, float, Term]] = []
        before = log2(bad / len(inside))
        for f in FEATURES:
            ordered = sorted((r[f], r["bad"]) for r in inside)
            k, n, b = 0, 0, 0
            for cut, gap in _cuts(inside, f):
                while k < len(ordered) and ordered[k][0] <= cut:
                    n, b, k = n + 1, b + ordered[k][1], k + 1
                for above, size, hits in ((False, n, b), (True, len(inside) - n, bad - b)):
                    gain = hits * (log2(hits / size) - before) if hits else 0
                    if gain > 1e-9:
                        tried.append((gain, gap, Term(f, above, cut)))
        if not tried:
            break
        top = max(t[0] for t in tried)
        term = max((t for t in tried if t[0] >= NEAR * top), key=lambda t: (t[1], t[0], t[2].feature, t[2].above, t[2].cut))[2]
        terms.append(term)
        inside = [r for r in inside if term.holds(r)]
    return terms


def _quality(terms: list[Term], rows: list[dict]) -> tuple[float, int]:
    """Share of rejected rows among the covered ones, smoothed, and their number."""
    covered = [r["bad"] for r in rows if all(t.holds(r) for t in terms)]
    return (sum(covered) + 1) / (len(covered) + 2), sum(covered)


def _centred(terms: list[Term], rows: list[dict]) -> list[Term]:
    """Each threshold moved to the middle of the gap between the rejected rows that the rule covers and the other rows."""
    for i, t in enumerate(terms):
        inside = [r for r in rows if all(u.holds(r) for u in terms[:i] + terms[i + 1 :])]
        sign = 1 if t.above else -1
        bad = [sign * r[t.feature] for r in inside if r["bad"] and t.holds(r)]
        good = [sign * r[t.feature] for r in inside if not r["bad"]]
        if bad and (below := [v for v in good if v < min(bad)]) and not any(v >= min(bad) for v in good):
            terms = [*terms[:i], Term(t.feature, t.above, sign * (max(below) + min(bad)) / 2), *terms[i + 1 :]]
    return terms


def learn(rows: list[dict]) -> list[Rule]:
    """Sequential covering: an ordered list of rules for `bad` rows."""
    rows = [r for r in rows if r["bad"] is not None]
    if len({r["bad"] for r in rows}) < 2:
        return []
    grow = [r for i, r in enumerate(rows) if i % 3 < 2]
    prune = [r for i, r in enumerate(rows) if i % 3 == 2]
    out: list[Rule] = []
    while len(out) < MAX_RULES and any(r["bad"] for r in grow):
        terms = _grow(grow)
        while len(terms) > 1 and _quality(terms[:-1], prune) >= _quality(terms, prune):
            terms = terms[:-1]
        if not terms:
            break
        terms = _centred(terms, rows)
        share, hits = _quality(terms, prune)
        covered = [r for r in rows if all(t.holds(r) for t in terms)]
        right = sum(r["bad"] for r in covered)
        if share < PRECISION - 1 / (hits + 2) or right < LEAST or right < PRECISION * len(covered):
            break
        rule = Rule(tuple(terms), right / len(covered))
        out.append(rule)
        grow, prune = ([r for r in part if not rule.covers(r)] for part in (grow, prune))
        rows = [r for r in rows if not rule.covers(r)]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn the list from labelled documents: `quality` 0 is what rules reject."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
    chosen = common.least_hashed(chosen.withColumn("_h", F.xxhash64("_id")), "_h", SAMPLE, ["_id", "_q"]).drop("_h")  # the documented bound
    x = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    x = statistics(x, ["_id", "_q"]).select("_id", "_q", "base_failed", "n_words", *FEATURES)
    rows = [r.asDict() for r in x.orderBy(F.xxhash64("_id"), "_id", "_q", "n_words").limit(SAMPLE).collect()]
    return learn([{**r, "bad": int(r["_q"] == 0)} for r in rows if not r["base_failed"]])


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, or null: an ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(0))
    for i, r in enumerate(rules[1:], 1):
        out = out.when(r.column(), F.lit(i))
    return out


def judged(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Statistics with base_failed, rule (number of the rule that rejects) and kept."""
    x = statistics(docs, keep or ["doc_id"])
    return x.withColumn("rule", verdict(rules)).withColumn("kept", (F.col("_at") >= 0) & ~F.col("base_failed") & F.col("rule").isNull())


def kept_only(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    whole = docs.select(F.struct(*(common.column(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), F.col("text"))
    out = judged(whole, rules, ["row"]).filter("kept")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
