"""Click windows, vantage-point trees and token alignment against brute force, with awkward rows."""

import collections
import datetime as dt
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("fluvia.llm")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fluvia.llm import alignment, clicks, neighbours  # noqa: E402

EPOCH = dt.datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, n long"


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute_windows(rows, batches=12, span=72, wait=48):
    """The contract, one copy at a time."""
    copies = []
    for i, ts, arrived, client, kind, value, props in rows:
        if i is None or arrived is None:
            continue
        for j in range(i % 3 + 1):
            c = zlib.crc32(f"{i}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            cents = None if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
            text = "|".join("" if x is None else str(x) for x in (client, kind, cents, None if ts is None else micros(ts), props, c % 3))
            copies.append((i, hour, hour + c // 10 % 200, hashlib.sha256(text.encode()).hexdigest()))
    low, high = min(c[2] for c in copies), max(c[2] for c in copies)
    fed = collections.defaultdict(list)
    for c in copies:
        fed[(c[2] - low) * batches // (high - low + 1)].append(c)
    latest, held, out = None, {}, []
    for b in range(batches):
        for i, hour, _, digest in sorted((c for c in fed[b] if latest is None or c[1] >= latest - wait), key=lambda c: (c[0], c[1], c[3])):
            w = held.get(i)
            if w and hour <= w[0] + span:
                w[2] += 1
                if digest != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(digest.encode())
                continue
            if w:
                out.append((i, w[0], b, *w[2:], w[1]))
            held[i] = [hour, digest, 0, 0, 0]
        latest = max([c[1] for c in fed[b]] + ([] if latest is None else [latest]))
        for i in [i for i, w in held.items() if b == batches - 1 or w[0] + span < latest - wait]:
            w = held.pop(i)
            out.append((i, w[0], b, *w[2:], w[1]))
    return collections.Counter(out)


def click_rows():
    r = np.random.default_rng(3)
    start = dt.datetime(2024, 3, 28)
    rows = []
    for i in range(120):
        for _ in range(1 + int(r.integers(0, 3))):
            at = start + dt.timedelta(hours=float(r.integers(0, 900)), seconds=int(r.integers(0, 3600)))
            rows.append((i, at if i % 7 else None, at, None if i % 5 == 0 else i, ["view", "click", None, "a|b"][i % 4], [1.005, None, -0.25, float("nan"), float("inf")][i % 5], None if i % 3 else '{"k": 1}'))
    rows += rows[:20]  # repeated rows
    hot = [(3, start, start + dt.timedelta(hours=h % 700), h % 2, "view", 1.0, None) for h in range(900)]
    return rows + hot + [(None, start, start, 1, "view", 1.0, None), (5, start, None, 1, "view", 1.0, None)]


@pytest.mark.parametrize("keys", [0, None])
def test_click_windows(spark, keys):
    rows = click_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], CLICKS)
    got = clicks.click_windows(table, keys=keys).withColumn("hash", F.lower(F.hex("hash")))
    assert collections.Counter(map(tuple, got.collect())) == brute_windows(rows)


def test_click_windows_of_an_empty_table(spark):
    assert clicks.click_windows(spark.createDataFrame([], CLICKS)).count() == 0


def test_click_windows_of_equal_times_and_before_1970(spark):
    at = dt.datetime(1969, 12, 31, 23, 30)
    rows = [(k % 4, at, at, k % 2, None, 2.0, None) for k in range(12)]
    got = clicks.click_windows(spark.createDataFrame([(*r, "x", 1) for r in rows], CLICKS)).withColumn("hash", F.lower(F.hex("hash")))
    assert collections.Counter(map(tuple, got.collect())) == brute_windows(rows)


def test_fold_across_chunks_and_batches():
    """Gathered in any chunks, equal rows together: the same windows as one event after another."""
    r = np.random.default_rng(0)
    for _ in range(60):
        n = int(r.integers(1, 40))
        ids, hours = r.integers(0, 4, n), r.integers(-30, 400, n)
        raw = [hashlib.sha256(str(k).encode()).digest() for k in r.integers(0, 5, n)]
        held, closed = clicks.Windows.unpacked(None), []
        want_closed, open_ = [], {}
        for part in np.array_split(np.arange(n), 2):
            if not len(part):
                continue
            rows = clicks.together(ids[part], hours[part], clicks.words(b"".join(raw[k] for k in part)), np.ones(len(part), dtype=np.int64))
            shut, held = clicks.fold(held, *rows, 72)
            closed += [tuple(x) for x in shut.rows(0).drop(columns="closed_batch").to_numpy()]
            for k in sorted(part, key=lambda k: (ids[k], hours[k], raw[k])):
                w = open_.get(ids[k])
                if w and hours[k] <= w[0] + 72:
                    w[1] += 1
                    w[2] += raw[k] != w[4]
                    w[3] += zlib.crc32(raw[k].hex().encode()) * (raw[k] != w[4])
                    continue
                if w:
                    want_closed.append((ids[k], *w))
                open_[ids[k]] = [hours[k], 0, 0, 0, raw[k]]
        assert sorted(closed) == sorted(want_closed)
        assert sorted(tuple(x) for x in held.rows(0).drop(columns="closed_batch").to_numpy()) == sorted((i, *w) for i, w in open_.items())
        assert clicks.Windows.unpacked(held.packed()).rows(0).equals(held.rows(0))


def clustered(n=2000, d=12):
    r = np.random.default_rng(8)
    middle = r.normal(size=(20, d)) * 3
    return np.concatenate([middle[k] + r.normal(size=(n // 20, d)) * r.uniform(0.1, 1) for k in range(20)]).astype(np.float32)


def test_vantage_point_tree():
    p = clustered()
    t = neighbours.Tree.load(neighbours.Tree.build(p, leaf=16).dump())
    assert sorted(t.order.tolist()) == list(range(len(p)))
    q = p[::40]
    d = np.sqrt(((p[None].astype(float) - q[:, None].astype(float)) ** 2).sum(-1))
    truth = np.argsort(d, axis=1, kind="stable")[:, :10]
    weighed = []
    for factor, least in ((1.0, 1.0), (0.6, 0.95), (0.3, 0.6)):
        near, which, n = t.search(q, np.full(len(q), np.inf), 10, factor, np.arange(len(p)))
        recall = np.mean([len({*a} & {*b}) / 10 for a, b in zip(which.tolist(), truth.tolist(), strict=True)])
        assert recall >= least
        weighed.append(n)
        if factor == 1:
            assert (which == truth).all() and (near == np.take_along_axis(d, truth, axis=1)).all()
    assert weighed[0] > weighed[1] > weighed[2] and weighed[0] < 0.5 * len(q) * len(p)


def brute_nearest(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    out = set()
    for q, v in best.items():
        if q % every == 0:
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in best.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, rank + 1, i, round(s, 9)) for rank, (s, i) in enumerate(d)}
    return out


def vector_rows():
    p = [list(map(float, v)) for v in clustered(600, 6)]
    rows = [(i, v) for i, v in enumerate(p)]
    rows += [(1000 + i, list(p[7])) for i in range(300)]  # a common vector
    rows += [(2000 + i, [float(i), 1.0]) for i in range(15)]  # another length
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [None] * 6), (3005, [float("nan")] * 6), (3010, [float("inf")] * 6), (None, p[0])]
    return rows + rows[:9] + [(4, p[5]), (20, p[9])]  # repeated rows, and ids with two vectors


@pytest.mark.parametrize("size", [10_000, 50])
def test_nearest(spark, size):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("x")).withColumn("shard", F.lit(1))
    out = neighbours.nearest(table, F.col("id") % 10 == 0, rows=size).collect()
    assert {(r[0], r[1], r[2], round(r[3], 9)) for r in out} == brute_nearest(rows, 10, 10) and len(out) == len({tuple(r[:2]) for r in out})
    loose = {(r[0], r[2]) for r in neighbours.nearest(table, F.col("id") % 10 == 0, factor=0.5, rows=size).collect()}
    assert len(loose & {(r[0], r[2]) for r in out}) >= 0.9 * len(out)
    assert neighbours.nearest(table.filter("false"), F.col("id") % 10 == 0).count() == 0


def test_nearest_against_sql(spark):
    data = "/root/testdata/sf0.001"
    got = sorted(map(tuple, neighbours.op12_vantage_point_search(spark, data).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{data}/embeddings.parquet')")
    want = sorted(con.execute(neighbours.SQL).fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want, strict=True)) < 1e-12


A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ALIGNED = [
    "The quick brown fox jumps over the lazy dog.", "  two  spaces   and\n\nlines\tand tabs \n", "", None, " ", "\n", "naïve 你好 \U0001f600 é ﬁ ＡＢ", "<|endoftext|> <s> </s> <unk> <0x0A> ▁x ▁",
    "x" * 3000, "word " * 4000, "a b　c d", "{\r\n\t\treturn (x);\r\n}", "The quick brown fox jumps over the lazy dog.", "ALİ, İ yazdı", "…—“”", "tail ", " lead", "a\x00b", "don't 1234567 v2.0",
]


def brute_alignment(rows):
    """The whole libraries on whole texts, one pair of tokens after another."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {**{chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown.values())}
    piece = lambda i: bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", sp.id_to_piece(i))) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], collections.Counter()
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ta, tb = [bytes(shown[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            found.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in ts]).tolist() for ts in (ta, tb)]
        begins = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, np.searchsorted(ends[1], begins[0][i], "right")), len(b)) if begins[1][j] < ends[0][i] and begins[0][i] < ends[1][j]] if len(a) < 400 else None
        if links is None:  # long texts: a walk along both
            i = j = 0
            links = []
            while i < len(a):
                links.append((a[i], b[j]))
                x, y = ends[0][i], ends[1][j]
                i, j = i + (x <= y), j + (y <= x)
        groups = [[], []]
        for k, (ids, e) in enumerate(zip((a, b), ends, strict=True)):
            cut = set(ends[0]) & set(ends[1])
            own = [[]]
            for n, x in zip(ids, e, strict=True):
                own[-1].append(n)
                if x in cut:
                    own.append([])
            groups[k] = own[:-1]
        held.update(set(links))
        found.append((a, b, list(zip(*groups, strict=True)), links))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = collections.Counter()
    for (i, _), (a, b, groups, links) in zip(rows, found, strict=True):
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out[(i, len(a), len(b), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if a else "")] += 1
    return out


def test_alignment(spark):
    rows = [*enumerate(ALIGNED), (None, "The quick brown fox"), (3, ALIGNED[0]), (0, ALIGNED[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("x")).withColumn("n", F.lit(1))
    got = alignment.alignment(docs.repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == brute_alignment(rows)
    assert alignment.alignment(docs.filter("false"), A, B).count() == 0


def test_alignment_of_random_texts():
    """Ids of both tokenizers, whatever the worker has met before, are the libraries' on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    r = np.random.default_rng(4)
    parts = ["a", "The", "é", "İ", "İ,", "é", ".", ",", " ", "  ", "\n", "\r", "\t", " ", "你", "x1", "'s", "▁", "<s>", "—"]
    texts = ["".join(r.choice(parts, r.integers(1, 14))) for _ in range(3000)]
    for got, text in zip(alignment.piece_encoder(B).arrays(texts), texts, strict=True):
        assert got.tolist() == sp.encode(text), text
    for got, text in zip(alignment.spaced_arrays(texts, A), texts, strict=True):
        assert got.tolist() == t.encode(" " + text, add_special_tokens=False).ids, text


def test_shards_split_and_sum(spark):
    """Many small shards and partial counts give the counts of one pass."""
    r = np.random.default_rng(2)
    keys = [np.unique(r.integers(0, 500, 60) << 32 | r.integers(0, 3, 60)) for _ in range(80)]
    docs = spark.createDataFrame([(k.astype("<i8").tobytes(),) for k in keys], "keys binary").repartition(5)
    want = collections.Counter(int(x) for k in keys for x in k)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/shards-test"
    shards = alignment.write_shards(alignment.partial_counts(docs), folder, 7)
    counts = alignment.Counts(folder, shards)
    every = np.array(sorted(want))
    assert len(shards) > 3 and counts.of(every).tolist() == [want[k] for k in every.tolist()]
    best = alignment._best(spark, counts, 500)
    assert all(best[a] == max(n for k, n in want.items() if k >> 32 == a) for a in range(500) if any(k >> 32 == a for k in want))
