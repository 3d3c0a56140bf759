"""Secret scans with corpus-wide ownership, in DataFrame expressions only.

Candidates are found in whole texts with their places: the pieces between matches (a split by the pattern) and the matches
themselves (an extraction by the same pattern) interlock, so running sums of their lengths are the places. Each document
is a repository and its `source` the owner. Hashes of all candidates are counted over the corpus by distinct repositories
and distinct owners: one that several owners hold, in more than EXAMPLE_REPOS repositories, is a copied example; one that a single owner holds
and that looks random is live-looking. Repetitions in a document and (hash, owner) pairs are removed before any shuffle by hash.

Ownership decides which candidates become spans: those of the base kinds always, those of known formats (pem, jwt, forge) unless they are copied
examples, and long mixed strings without a format (random) only if they are live-looking and no other candidate holds them.

Edge cases: null or empty text has no candidates; null source is an owner of its own; rows with a null or a repeated doc_id are documents
of their own; a text with very many matches takes time by their number to the power 1.5; an empty table gives an empty result; extra
columns of any name are kept by `redacted` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common

#: Base kinds in order: pattern, group and least length of a match. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds that the method adds. Fixed values.
PEM = r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
FORGE = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
RANDOM = r"[A-Za-z0-9_-]{32,}"
KINDS = ("assign", "access", "hex", "pem", "jwt", "forge", "random")
PATTERNS = (ASSIGN, ACCESS, HEX, PEM, JWT, FORGE, RANDOM)
#: What a `random` candidate must have; digits in two places at least, as a numbered name has one.
MIXED = ("[0-9][^0-9]+[0-9]", "[a-z]", "[A-Z]")

#: What a text must hold before a pattern is tried on it: one of some strings, or a pattern.
HOLDS = {"access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_")}
GATES = {"assign": r"(?i)passw|secret|token|api_?key", "hex": HEX, "random": "[0-9]"}
#: In a text with a digit, where a `random` candidate may begin.
LONG = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32}"

#: A candidate in more repositories than this, of at least EXAMPLE_OWNERS owners, is a copied example.
EXAMPLE_REPOS, EXAMPLE_OWNERS = 3, 2
#: Least share of distinct characters among the first 20 of a live-looking value, and its least length.
LIVE_DISTINCT, LIVE_LENGTH = 0.4, 12


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once: an expression that stands in a lambda is computed anew in each of its calls."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, op) -> Column:
    """Inclusive running results of an associative operation with identity 0 over an array of longs.

    In blocks of about the root of its length, since appending to an array copies it.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    at = lambda a, i: F.coalesce(F.get(a, i), zero)
    append = lambda acc, x: F.concat(acc, F.array(op(at(acc, F.size(acc) - 1), x)))

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, size), lambda i: F.aggregate(F.slice(v, i + 1, size), none, append))

    def joined(b: Column) -> Column:
        ends = F.aggregate(F.transform(b, lambda x: at(x, F.size(x) - 1)), none, append)
        return _let(ends, lambda e: F.flatten(F.transform(b, lambda x, i: _let(at(e, i - 1), lambda before: F.transform(x, lambda y: op(before, y))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_let(blocks(v), joined)))


def may_hold(text: Column, kind: str) -> Column:
    if kind not in HOLDS:
        return text.rlike(GATES[kind])
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in HOLDS[kind]))


SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of structs (start, kind, end, value) of all leftmost non-overlapping matches; places are code points."""

    def placed(found: Column) -> Column:
        between = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
        ends = running(F.zip_with(between, found, lambda g, v: (g + F.length(v)).cast("long")), lambda a, b: a + b)
        return F.zip_with(ends, found, lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), v.alias("value")))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(may_hold(text, kind), found).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, source, found: all candidates of a document, by start and then kind as listed."""
    x = docs.select(*map(common.column, keep), F.col("source").cast("string").alias("source"), common.text_of().alias("text"))
    for kind, pattern in zip(KINDS, PATTERNS, strict=True):
        x = x.withColumn(f"_{kind}", matches(F.col("text"), kind, pattern))
    secret = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    x = x.withColumn("_assign", F.filter("_assign", lambda s: F.length(secret(s)) >= 6))
    x = x.withColumn("_random", F.filter("_random", lambda s: reduce(lambda a, b: a & b, (s["value"].rlike(m) for m in MIXED))))
    known = F.concat(*[F.col(f"_{k}") for k in KINDS[:-1]])
    within = lambda s: F.exists(known, lambda k: (k["start"] <= s["start"]) & (k["end"] >= s["end"]))
    x = x.withColumn("_random", F.when(F.size("_random") == 0, F.col("_random")).otherwise(F.filter("_random", lambda s: ~within(s))))
    found = F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS]))
    return x.select(*map(common.column, keep), "source", found.alias("found"))


def _value(s: Column) -> Column:
    """The secret itself: without the name it is assigned to."""
    return F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 1)).otherwise(s["value"])


def ownership(found: DataFrame) -> DataFrame:
    """hash, repos (distinct documents), owners (distinct sources) over the whole corpus; `found` has a row per document."""
    once = found.select(F.coalesce("source", F.lit("\u0000")).alias("source"), F.explode(F.array_distinct(F.transform("found", lambda s: F.sha2(_value(s), 256)))).alias("hash"))
    by_owner = once.groupBy("hash", "source").agg(F.count("*").alias("n"))  # partial sums: a copied example is a row per task
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repos"), F.count("*").alias("owners"))


def _judged(docs: DataFrame, row: str, *keep: str) -> DataFrame:
    """`keep`, found (all candidates) and per row the distinct values that are copied `examples` and those that are `live`-looking;
    `row` numbers the rows."""
    found = common.written(candidates(docs, row, *(c for c in keep if c != row)), "secret-candidates")
    owners = common.written(ownership(found), "secret-owners")
    some = found.filter(F.size("found") > 0)
    each = some.select(common.column(row).alias("_row"), F.explode(F.array_distinct(F.transform("found", _value))).alias("value")).withColumn("hash", F.sha2("value", 256))
    known = common.hot_lookup(each, owners, "hash", "repos", found.count(), F.xxhash64("_row", "value"))
    example = (F.col("repos") > EXAMPLE_REPOS) & (F.col("owners") >= EXAMPLE_OWNERS)
    head = F.split(F.substring("value", 1, 20), "")
    random_looking = (F.length("value") >= LIVE_LENGTH) & (F.size(F.array_distinct(head)) >= LIVE_DISTINCT * F.size(head))
    live = (F.col("owners") == 1) & random_looking
    by = known.groupBy("_row").agg(F.collect_set(F.when(example, F.col("value"))).alias("_examples"), F.collect_set(F.when(live, F.col("value"))).alias("_live"))
    none = F.array().cast("array<string>")
    x = found.join(by, common.column(row) == F.col("_row"), "left")
    return x.select(*map(common.column, keep), "found", F.coalesce("_examples", none).alias("examples"), F.coalesce("_live", none).alias("live"))


def _spans() -> Column:
    """Of `found`, what ownership lets be spans."""
    formats = lambda s: (s["kind"] < KINDS.index("random")) & ~F.array_contains("examples", _value(s))
    return F.filter("found", lambda s: (s["kind"] < 3) | formats(s) | F.array_contains("live", _value(s)))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found (the base candidates and those that ownership adds), n_example, n_live (distinct candidates of the document that are
    copied examples, or look live) and examples (the values of the former)."""
    numbered, row, _ = common.with_row_ids(docs)
    x = _judged(numbered.withColumn("doc_id", F.col("doc_id").cast("long")), row, "doc_id")
    return x.select("doc_id", _spans().alias("found"), F.size("examples").cast("long").alias("n_example"), F.size("live").cast("long").alias("n_live"), "examples")


def written_out(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span in `text` but the copied examples replaced by its kind in brackets, at its place: of an assignment the value
    only. Spans that overlap become one, named by the first. Only rows with candidates are joined."""
    numbered, row, _ = common.with_row_ids(docs)
    place = lambda s: F.struct((s["end"] - F.length(_value(s))).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    cut = F.sort_array(F.transform(F.filter(_spans(), lambda s: ~F.array_contains("examples", _value(s))), place))
    cuts = common.written(_judged(numbered, row, row).select(common.column(row).alias("secret_row"), cut.alias("secret_cuts")).filter("size(secret_cuts) > 0"), "secret-cuts")
    gate, text = common.fresh(numbered, "secret_gate"), F.col("text")
    any_kind = reduce(lambda a, b: a | b, (may_hold(text, k) & (text.rlike(LONG) if k == "random" else F.lit(True)) for k in KINDS))
    x = numbered.withColumn(gate, F.coalesce(any_kind, F.lit(False)))
    at, here = common.fresh(x, "secret_row"), common.fresh(x, "secret_cuts")
    v, name = common.column(here), F.array(*map(F.lit, KINDS))
    part = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))

    def cut_out(reached: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reached, i - 1), F.lit(0).cast("long"))
            return F.when(s["start"] >= before, F.concat(part(before, s["start"] - before), F.lit("["), F.get(name, s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(v, piece), ""), part(F.element_at(reached, -1), F.length(text)))

    out = _let(running(F.transform(v, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), cut_out)
    cuts = cuts.withColumnsRenamed({"secret_row": at, "secret_cuts": here})
    met = x.filter(common.column(gate)).join(cuts.hint("merge"), common.column(row) == common.column(at), "left")
    met = met.withColumn("text", F.when(v.isNull(), text).otherwise(out))
    return x.filter(~common.column(gate)).select(*map(common.column, docs.columns)).unionByName(met.select(*map(common.column, docs.columns)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = common.tidied(lambda: secrets(common.documents(spark, sf_dir)))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return x.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"), "n_example", "n_live")


def _sql() -> str:
    """The same in DuckDB: list functions over splits and extractions."""

    def found(kind: str, pattern: str, least: str = "true") -> str:
        p = pattern.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
            'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0)::BIGINT,
            'n': length(regexp_extract_all(t, '{p}')[i]), 'kind': {KINDS.index(kind)}, 'value': {"regexp_extract(regexp_extract_all(t, '" + p + "')[i], '" + p + "', 1)" if kind == "assign" else "regexp_extract_all(t, '" + p + "')[i]"}
        }}), lambda s: {least})"""

    parts = [found("assign", ASSIGN, "length(s.value) >= 6"), found("access", ACCESS), found("hex", HEX), found("pem", PEM), found("jwt", JWT), found("forge", FORGE), found("random", RANDOM, " AND ".join(f"regexp_matches(s.value, '{m}')" for m in MIXED))]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    line = lambda v: f"coalesce(array_to_string(list_transform({v}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.n)), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, source, list_sort(list_transform(list_concat({", ".join(parts)}), lambda s: {{'start': s.start, 'kind': s.kind, 'n': s.n, 'value': s.value}})) AS every FROM d),
f AS (SELECT doc_id, source, list_filter(every, lambda s: s.kind < {KINDS.index("random")} OR len(list_filter(every, lambda k: k.kind < {KINDS.index("random")} AND k.start <= s.start AND k.start + k.n >= s.start + s.n)) = 0) AS found FROM a),
e AS (SELECT DISTINCT doc_id, coalesce(source, chr(0)) AS source, v.value AS value FROM f, unnest(found) AS u(v)),
o AS (SELECT value, count(*) AS repos, count(DISTINCT source) AS owners FROM e GROUP BY value),
j AS (SELECT doc_id, list(value) FILTER (repos > {EXAMPLE_REPOS} AND owners >= {EXAMPLE_OWNERS}) AS examples,
        list(value) FILTER (owners = 1 AND length(value) >= {LIVE_LENGTH} AND len(list_distinct(string_split(value[1:20], ''))) >= {LIVE_DISTINCT} * len(string_split(value[1:20], ''))) AS live
      FROM e JOIN o USING (value) GROUP BY doc_id),
s AS (SELECT f.doc_id, coalesce(len(examples), 0)::BIGINT AS n_example, coalesce(len(live), 0)::BIGINT AS n_live,
        list_filter(found, lambda s: s.kind < 3 OR (s.kind < {KINDS.index("random")} AND NOT coalesce(list_contains(examples, s.value), false)) OR coalesce(list_contains(live, s.value), false)) AS spans
      FROM f LEFT JOIN j USING (doc_id))
SELECT doc_id, len(list_filter(spans, lambda s: s.kind = 0))::BIGINT AS n_assign, len(list_filter(spans, lambda s: s.kind = 1))::BIGINT AS n_access,
  len(list_filter(spans, lambda s: s.kind = 2))::BIGINT AS n_hex, sha256({line("list_filter(spans, lambda s: s.kind < 3)")}) AS base_sha256,
  {line("spans")} AS spans, n_example, n_live
FROM s
"""


SQL = _sql()
