"""Queries on tables that show what the given ones hide, against their SQL."""

import duckdb
import pytest
from test_queries import DATA, QUERIES, SQL, rows


def agrees(spark, folder, name, **tables):
    """Rows of `name` on a folder of these tables (SELECTs of DuckDB), equal to those of its SQL."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for table, select in tables.items():
        c.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df, out = QUERIES[name](spark, str(folder)), c.execute(SQL[name])
    names = [d[0] for d in out.description]
    got = rows(df.columns, df.collect())
    assert got == rows(names, out.fetchall()) and got
    return df


given = lambda table: f"SELECT * FROM read_parquet('{DATA}/{table}.parquet')"


def test_a_source_without_an_event_sends_nothing(spark, tmp_path):
    short = given("lineitem").replace("*", "* REPLACE (TIMESTAMP '1992-01-01' AS l_shipdate)")
    df = agrees(spark, tmp_path, "eva_8_observed_exposure", lineitem=short, **{t: given(t) for t in ("supplier", "part", "orders")})
    assert df.filter("active = 0 AND exposure = 0").count() > 0


def _days(total: str) -> str:
    """Events of 2000 cells, each with 24 hours of one day whose hundredths come to `total`."""
    part = "(hash(c * 100 + h) % 600)"
    return f"""WITH x AS (SELECT c, h, {part} AS v FROM range(2000) a(c), range(23) b(h)), y AS (SELECT c, h, v FROM x UNION ALL SELECT c, 23, {total} * 100 - sum(v) FROM x GROUP BY 1)
SELECT c * 24 + h AS event_id, TIMESTAMP '2024-01-01' + to_hours(h::INT) AS ts, c AS user_id, 'view' AS event_type, v::DOUBLE / 100 AS value, '' AS props FROM y"""


def test_the_order_of_a_sum_decides_no_headline(spark, tmp_path):
    df = agrees(spark, tmp_path, "rul_4_headline", events=_days("200"))
    assert [tuple(r) for r in df.groupBy("headline").count().collect()] == [("Wet", 2000)]


def test_the_order_of_a_sum_decides_no_half(spark, tmp_path):
    df = agrees(spark, tmp_path, "snk_9_daily_document", events=_days("169.5"))
    assert df.select("p").distinct().count() == 1


def test_a_closure_broadcasts_nothing(spark, monkeypatch):
    from fluvia.operators import graph

    plans, step = [], graph._step

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return step(df)

    monkeypatch.setattr(graph, "_step", seen)
    e = spark.createDataFrame([(k + 1, k, 1.0) for k in range(1, 20)], "src long, dst long, length double")
    assert graph.closure(e, spark.createDataFrame([(1,)], "node long"), 100.0).count() == 20
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_sums_of_a_travel_shift_are_dealt_out(spark):
    from fluvia.operators import temporal

    x = spark.range(4000).selectExpr("id % 1000 AS k", "DATE '2024-01-01' + CAST(id % 7 AS INT) AS d", "CAST(id % 50 AS DOUBLE) AS h", "1D AS p")
    one, many = (temporal.travel_shift(x, "d", "h", "p", ["k"], n) for n in (None, 9))
    assert many.rdd.getNumPartitions() == 9
    round_ = lambda df: sorted((r.k, r.d, round(r.p, 9)) for r in df.collect())
    assert round_(one) == round_(many)


def test_every_half_and_an_event_without_a_time(spark, tmp_path):
    """Days of each half thousandth, and events with no time, whose day comes last on both sides."""
    part = "(hash(c * 100 + h) % 600)"
    parts = f"WITH x AS (SELECT c, h, {part} AS v FROM range(1100) a(c), range(23) b(h)), y AS (SELECT c, h, v FROM x UNION ALL SELECT c, 23, c * 100 + 50 - sum(v) FROM x GROUP BY 1)"
    days = f"{parts} SELECT c * 24 + h AS event_id, TIMESTAMP '2024-01-01' + to_hours((24 * (c % 50) + h)::INT) AS ts, c // 50 AS user_id, 'view' AS event_type, v::DOUBLE / 100 AS value, '' AS props FROM y"
    untimed = "SELECT 100000 + c, NULL, c, 'view', 7.5, '' FROM range(22) t(c)"
    df = agrees(spark, tmp_path, "snk_9_daily_document", events=f"{days} UNION ALL {untimed}")
    got = {r.cell: r.p.split(",") for r in df.collect()}
    assert got[0][0] == "1" and got[19][-2] == "1000" and got[0][-1] == "8"


def test_overlaps_of_one_hot_site_make_no_pair(spark, tmp_path):
    """Half of the orders at one site, at odd times: agrees with the SQL, and samples are not copied to buckets to be joined."""
    orders = given("orders").replace("*", "* REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_custkey END AS o_custkey, o_orderdate + to_seconds((hash(o_orderkey) % 90000)::BIGINT) AS o_orderdate)")
    df = agrees(spark, tmp_path, "eva_8_overlaps", orders=orders, lineitem=given("lineitem"))
    assert "_bucket" not in df._jdf.queryExecution().executedPlan().toString()
