"""Registry of queries: each has a Spark plan and, where SQL can express it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on demand; each query selects its columns, so scans are pruned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables as the query `name`."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def project(name: str, table: str, key: str, spark_cols: dict, sql_cols: dict[str, str], where: str | None = None) -> None:
    """A query of expressions over one table; `spark_cols` are columns or functions of none."""

    def run(t: Tables) -> DataFrame:
        df = getattr(t, table)
        df = df.filter(where) if where else df
        return df.select(*key.split(", "), *[(c() if callable(c) else c).alias(n) for n, c in spark_cols.items()])

    cols = ", ".join(f"{c} AS {n}" for n, c in sql_cols.items())
    query(name, f"SELECT {key}, {cols} FROM {table}" + (f" WHERE {where}" if where else ""))(run)


def big(c) -> object:
    return c.cast("bigint")


col, lit = F.col, F.lit
