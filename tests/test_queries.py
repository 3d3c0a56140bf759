"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
import re

import duckdb
import pytest

from fluvia.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return re.sub(r" 00:00:00$", "", str(v)) if not isinstance(v, (int, bool)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in SQL:
        out = con.execute(SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, out.fetchall())
