"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

Four base kinds (email, ip, card, phone) have fixed formats with validity rules; their spans are always reported. Looser generators
propose further, overlapping candidates (numbers without a plus sign, national numbers, bank accounts, long addresses, dates of
birth, written-out emails). Each gets features of its format and of the text around it; a boosted classifier accepts those with a
probability of at least the threshold that gives PRECISION on held-out rows. It is fitted and calibrated on two bounded sets of labelled rows:
TRAINING_ROWS generated ones (formats that a corpus may lack, announced by the words of FOR and AGAINST), and at most SAMPLE candidates of the
corpus itself, those with the least hashes, in their real contexts: one that covers a valid base span is personal data, a number that
fails a card's checksum is not, and the others have no label (see `labelled`). Of overlapping accepted candidates the more probable stays; one that overlaps a base span goes.

Edge cases: null or empty text has no spans and empty strings; repeated rows are scanned each; every regex runs in linear time, so
very long texts are scanned whole; an empty table gives an empty result; extra columns are ignored. Positions are code points.
"""

from __future__ import annotations

import bisect
import heapq
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.boosting import Boosted
from fluvia.llm.encoding import slices

#: Labelled rows: generated, and at most so many candidates of the corpus.
TRAINING_ROWS, SAMPLE = 3000, 3000
PRECISION = 0.98
CONTEXT = 32

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, with their generators. Fixed patterns.
EXTRA = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "bank_account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "birth_date": r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "spelt_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,20}){1,3}",
    "long_number": r"(?<![0-9.,])[0-9]{9,19}(?![0-9])",
}
KINDS = (*BASE_KINDS, *EXTRA)
_EXTRA = {k: re.compile(v) for k, v in EXTRA.items()}

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[ .-]?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email format, found from each at sign outwards in linear time."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and at >= end and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid base matches, by start and then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the generators."""
    digits = bool(_DIGIT.search(text))
    if not digits and "at]" not in text and "at)" not in text:
        return []
    return [(k, *m.span()) for k, p in _EXTRA.items() if digits or k == "spelt_email" for m in p.finditer(text)]


#: Words that speak for or against personal data near a candidate. Fixed values.
FOR = re.compile(r"(?i)\b(?:phone|tel|mobile|cell|call|fax|contact|ssn|social|security|iban|account|bank|born|birth|dob|email|mail|write|passport|id|customer|patient|card|ip|address)\b")
AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|page|figure|isbn|issn|serial|part|item|total|sum|amount|since|published|ratio|build|commit|chapter|table|released|updated|id3|checksum|mac)\b")


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT // 2]
    d = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    yes, no = FOR.findall(before), AGAINST.findall(before)
    return [
        *(float(kind == k) for k in EXTRA),
        float(len(s)), float(len(d)), float(len(groups)), float(max(map(len, groups), default=0)), len(d) / max(1, len(s)),
        float(len(set(d)) <= 2), float(len(d) >= 12 and luhn(d)), float("(" in s), float(s.count("-")), float(s.count(".")), float(" " in s),
        float(len(yes)), float(len(no)), float(bool(FOR.search(after))), float(before.rstrip()[-1:] in (":", "=")), float(before[-1:] in ("$", "#", "€", "£", "/", "-")),
        float(bool(groups) and len(groups[0]) == 3 and groups[0] not in ("000", "666") and groups[0] < "900"), float(bool(_COUNTRY.search(before))),
    ]


def training(n: int = TRAINING_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates in generated contexts, with labels: real-looking data after words that announce it, and numbers of
    other sorts after words that announce those."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    fill = lambda: " ".join("".join(r.choice("aeiounrstlh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(2, 6)))
    makers = {
        "national_id": (lambda: f"{r.randint(1, 899):03d}-{dig(2)}-{dig(4)}", ("SSN", "social security", "id", "passport", "patient"), ("part", "serial", "item", "order", "isbn")),
        "local_phone": (lambda: r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(dig(3), dig(3), dig(4)), ("phone", "tel:", "call", "mobile:", "fax", "contact"), ("order", "invoice", "serial", "part", "total")),
        "bank_account": (lambda: f"{r.choice(('DE', 'FR', 'GB', 'ES'))}{dig(2)} {dig(4)} {dig(4)} {dig(4)} {dig(4)}", ("IBAN", "account", "bank:", "bank account"), ("serial", "checksum", "part", "build")),
        "ip6": (lambda: ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), ("ip", "address", "contact"), ("checksum", "mac", "commit", "serial")),
        "birth_date": (lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1930, 2010)}", ("born", "DOB:", "birth", "date of birth:"), ("published", "released", "updated", "version", "since", "")),
        "spelt_email": (lambda: f"{fill().split()[0]}{r.choice((' [at] ', '(at)', ' (at) '))}{fill().split()[0]}{r.choice(('.', ' [dot] ', ' (dot) '))}{r.choice(('com', 'org', 'de'))}", ("email", "mail", "write", "contact", ""), ("chapter", "table", "figure")),
        "long_number": (lambda: dig(r.randint(9, 16)), ("account", "passport", "customer", "patient id", "bank"), ("order", "invoice", "total", "isbn", "build", "serial", "")),
    }
    xs, ys = [], []
    while len(xs) < n:
        kind = r.choice(list(makers))
        make, good, bad = makers[kind]
        y = r.random() < 0.5
        word = r.choice(good if y else bad)
        s = make()
        text = f"{fill()} {word}{r.choice(('', ':', ' '))} "
        if s and (word or r.random() < 0.5):
            at = len(text)
            xs.append(features(f"{text}{s} {fill()}", (kind, at, at + len(s))))
            ys.append(y)
    return np.array(xs), np.array(ys, dtype=float)


def labelled(text: str, base: list[tuple[str, int, int]]) -> list[tuple[tuple[str, int, int], float]]:
    """The candidates of a text that the corpus itself labels. One that covers a valid base span (all but a country code and its plus sign) is
    personal data. A number as long as a card's that fails its checksum, with no word near that announces another kind of personal number, is not. The
    base formats say nothing of any other candidate, least of all of the kinds that they lack, so those have no label."""
    out, spans, at = [], sorted((a, b) for _, a, b in base), 0
    for s in sorted(candidates(text), key=lambda s: s[1]):
        kind, a, b = s
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if at < len(spans) and spans[at][0] < b:
            if spans[at][0] >= a - 5 and spans[at][1] == b:
                out.append((s, 1.0))
        elif kind == "long_number" and 12 <= b - a <= 19 and not luhn(text[a:b]) and not FOR.search(text[max(0, a - CONTEXT) : b + CONTEXT // 2]):
            out.append((s, 0.0))
    return out


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE labelled candidates of the corpus: the ones with the least hashes of their document and number. A task keeps as many at most, and computes
    the features of those alone."""

    def run(batches):
        least: list[tuple] = []
        for key, text in slices(batches, ["doc_id", "text"]):
            for k, t in zip(key, text, strict=True):
                if t and candidates(t):
                    for i, (s, y) in enumerate(labelled(t, base_spans(t))):
                        begin = max(0, s[1] - CONTEXT)
                        least.append((xxhash.xxh3_64_intdigest(f"{k}:{i}") >> 1, t[begin : s[2] + CONTEXT], (s[0], s[1] - begin, s[2] - begin), y))
            if len(least) > 4 * SAMPLE:
                least = heapq.nsmallest(SAMPLE, least)
        rows = [(at, features(t, s), y) for at, t, s, y in heapq.nsmallest(SAMPLE, least)]
        if rows:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.float64()), strict=True)], names=["at", "x", "y"])

    found = common.written(docs.mapInArrow(run, "at long, x array<double>, y double"), "pii-candidates")
    found = common.least_hashed(found, "at", SAMPLE, ["x", "y"], 0).collect()
    return np.array([r["x"] for r in found]), np.array([r["y"] for r in found], dtype=float)


@lru_cache(1)
def model() -> tuple[Boosted, float]:
    """The classifier and threshold of the generated rows alone."""
    return fitted(*training())


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[Boosted, float]:
    """The classifier, fitted on three fifths of the rows and calibrated on one, and the threshold: the lowest probability with PRECISION on the
    other fifth above it, 0.5 at least."""
    cut, held = int(0.6 * len(y)), int(0.8 * len(y))
    m = Boosted.fit(x[:cut], y[:cut]).calibrated(x[cut:held], y[cut:held])
    p, t = m.probability(x[held:]), y[held:]
    order = np.argsort(-p)
    good = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= PRECISION
    return m, max(0.5, float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0)


def fit(docs: DataFrame) -> tuple[Boosted, float]:
    """Classifier and threshold from the generated rows and the sample of `docs`."""
    x, y = training()
    more, labels = sample(docs)
    if len(labels):
        order = np.random.default_rng(7).permutation(len(y) + len(labels))
        x, y = np.concatenate([x, more])[order], np.concatenate([y, labels])[order]
    return fitted(x, y)


def accepted(text: str, base: list[tuple[str, int, int]], fitted: tuple[Boosted, float]) -> list[tuple[str, int, int]]:
    """The method's own spans: accepted, not overlapping a base span or a better one."""
    found = candidates(text)
    if not found:
        return []
    p = fitted[0].probability(np.array([features(text, s) for s in found]))
    kept: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    for q, s in sorted(zip(p, found, strict=True), key=lambda v: (-v[0], v[1][1] - v[1][2], v[1])):
        if q < fitted[1]:
            break
        k = bisect.bisect_left(taken, (s[1], s[2]))
        if (k < len(taken) and taken[k][0] < s[2]) or (k and taken[k - 1][1] > s[1]):
            continue
        kept.append(s)
        bisect.insort(taken, (s[1], s[2]))
    return kept


def written_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, base (array of kind, start, end), spans (base and accepted ones) and, unless `with_text` is false, the redacted text."""

    def run(batches):
        judge = held.value
        for key, text in slices(batches, ["doc_id", "text"]):
            rows = []
            for k, t in zip(key, text, strict=True):
                t = t or ""
                base = base_spans(t)
                spans = sorted(base + accepted(t, base, judge), key=lambda s: (s[1], KINDS.index(s[0])))
                dict_ = lambda v: [{"kind": x, "start": a, "end": b} for x, a, b in v]
                rows.append((k, dict_(base), dict_(spans), redacted(t, spans) if with_text else None))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span)), ("redacted", pa.string())])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))  # of a fixed size
    s = "array<struct<kind:string,start:long,end:long>>"
    out = docs.mapInArrow(run, f"doc_id long, base {s}, spans {s}, redacted string")
    return out if with_text else out.drop("redacted")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first."""
    out, last = [], 0
    for k, a, b in spans:
        if a >= last:
            out += [text[last:a], f"[{k}]"]
            last = b
    return "".join([*out, text[last:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.tidied(lambda: find_pii(common.documents(spark, sf_dir), with_text=False))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
