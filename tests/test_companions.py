"""The companion met most often, against brute force and SQL."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from test_against_sql import agrees, given

from fluvia.operators import companions


def brute(rows):
    cells, n = defaultdict(Counter), defaultdict(Counter)
    for w, k, s, m in rows:
        if None not in (w, k, s):
            cells[k, s][w] += m
    for met in cells.values():
        for a in met:
            for b in met:
                if a != b:
                    n[a][b] += met[a] * met[b]
    return {a: max(c, key=lambda b: (c[b], -b)) for a, c in n.items()}


@pytest.mark.parametrize(("heavy", "block"), [(1, 32768), (2, 7), (40, 13)])
def test_most_frequent(spark, heavy, block):
    r = np.random.default_rng(heavy)
    seen = {(int(w), "abc"[k], int(s)): int(m) for w, k, s, m in zip(r.integers(-20, 60, 700), r.integers(0, 3, 700), r.integers(0, 25, 700), r.integers(1, heavy + 1, 700), strict=True)}
    rows = [(*key, m) for key, m in seen.items()]
    rows += [(w + 1000 * c, k, s, m) for w, k, s, m in rows if w % 3 == 0 for c in (1, 2)]  # classes of three
    rows += [(5000, "z", 1, 1), (5001, "y", 1, 2), (5002, "y", 1, 2), (5003, None, 1, 1), (5004, "a", None, 1), (None, "a", 1, 1)]
    x = spark.createDataFrame(rows, "w long, k string, s long, m long")
    got = [tuple(x) for x in companions.most_frequent(x, "w", "k", "s", "m", block).collect()]
    want = brute(rows)
    assert dict(got) == want and len(got) == len(want) and 5000 not in want and want[5002] == 5001


@pytest.mark.parametrize("spread", [0, 7])
def test_no_pair_is_made_by_a_join(spark, tmp_path, spread):
    """Copies of all users, equal or an hour apart by a hash: agrees with the SQL, and no join by hour and type is left in the plan."""
    events = given("events").replace("*", f"e.* REPLACE (ts + to_hours((hash(event_id + k) % {spread + 1})::INT) AS ts, user_id + k * 1000 AS user_id)").replace("FROM", "FROM range(4) r(k),") + " e"
    df = agrees(spark, tmp_path, "jon_20_co_observation", events=events)
    assert "event_type" not in df._jdf.queryExecution().executedPlan().toString()


def test_nobody_meets(spark):
    x = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "w long, k string, s long, m long")
    assert companions.most_frequent(x, "w", "k", "s", "m").isEmpty() and companions.most_frequent(x.filter("w > 9"), "w", "k", "s", "m").isEmpty()
