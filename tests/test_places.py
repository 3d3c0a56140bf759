"""Many rows at few places: distances are taken by distinct places, and every row gets its result."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import DATA, QUERIES, SQL, rows

from fluvia.operators import spatial

COPIES = 12
#: Queries that give each pin one row.
PLACES = ["geo_10_inland", "geo_1_pin_location", "geo_2_name_hint", "geo_3_main_channel", "grf_3_gap_repair", "geo_4_second_pass", "jon_17_nearest_listed", "jon_14_nearest", "geo_9_snap_to_set"]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest customers and suppliers, COPIES times with other keys, at the same places."""
    folder = tmp_path_factory.mktemp("copies")
    c = duckdb.connect()
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        c.execute(f"COPY (SELECT x.* REPLACE ({key} + r * 1000 AS {key}) FROM read_parquet('{DATA}/{table}.parquet') x, range({COPIES}) g(r)) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return c, str(folder)


def agrees(spark, copies, name):
    c, folder = copies
    df = QUERIES[name](spark, folder)
    out = c.execute(SQL[name])
    names = [d[0] for d in out.description]
    want = rows(names, out.fetchall())
    assert rows(df.columns, df.collect()) == want and len(want) > COPIES


def test_ring_join_takes_a_place_once(spark, copies):
    agrees(spark, copies, "jon_16_ring_join")
    ring = [{"x": math.cos(k / 500 * math.pi), "y": math.sin(k / 500 * math.pi)} for k in range(1000)]
    lakes = spark.createDataFrame([(1, ring), (2, ring)], "g int, ring array<struct<x double, y double>>")
    points = spark.range(1_000_000).selectExpr("id AS p", "0.5 AS px", "0.1 AS py").selectExpr("p", "CAST(px AS DOUBLE) AS px", "CAST(py AS DOUBLE) AS py")
    began = time.time()
    got = spatial.ring_join(points, lakes, 4.0, 1.0).selectExpr("count(*)", "count_if(inside)", "count(DISTINCT to_shore)", "sum(g)", "sum(p)").first()
    assert tuple(got) == (2_000_000, 2_000_000, 1, 3_000_000, 999_999_000_000)
    assert time.time() - began < 60  # 2e9 edges, if each row met them


#: So many copies that the pairs of rows would take minutes.
CROWD = 3000


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("crowd")
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        duckdb.execute(f"COPY (SELECT x.* REPLACE ({key} + r * 1000 AS {key}) FROM read_parquet('{DATA}/{table}.parquet') x, range({CROWD}) g(r)) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", PLACES)
def test_a_place_is_searched_once(spark, copies, crowd, name):
    agrees(spark, copies, name)
    alone, began = QUERIES[name](spark, DATA), time.time()
    base = lambda df: df.selectExpr(*[f"{c} % 1000 AS {c}" if t == "bigint" else c for c, t in df.dtypes])
    got = base(QUERIES[name](spark, crowd)).groupBy(*alone.columns).count().collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((tuple(r) for r in alone.collect()), key=repr) and {r["count"] for r in got} == {CROWD}
    assert time.time() - began < 60


def test_within_join_is_dealt_to_many_tasks(spark):
    x = spark.range(100_000).selectExpr("id", "CAST(id % 1000 AS DOUBLE) AS px", "CAST(id % 7 AS DOUBLE) AS py")
    q = spark.range(3000).selectExpr("id AS k", "CAST(id % 1000 AS DOUBLE) AS qx", "CAST(id % 7 AS DOUBLE) AS qy")
    counts = [r["count"] for r in spatial.within_join(x, q, 0.5).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 44_000 and len(counts) > 5 and max(counts) < sum(counts) / 3


def test_of_points_at_one_place_the_best_is_kept(spark):
    x = spark.range(60_000).selectExpr("id AS k", "CAST(id % 59999 AS INT) AS rank", "0D AS px", "0D AS py").unionByName(spark.createDataFrame([(-1, 70_000, 5.0, 0.0), (-2, None, 0.0, 0.0), (-3, 1, 9.0, 0.0)], "k long, rank int, px double, py double"))
    began = time.time()
    assert sorted(r.k for r in spatial.greedy_dedupe(x, "k", "rank", 4.5).collect()) == [-2, -1, 59998]
    assert time.time() - began < 30  # 1.8e9 links, if each row met the others
