"""Paged reads, choices between reads, and forms."""

import os
import pathlib
import time

from pyspark.sql import functions as F

from fluvia.sinks import publish
from fluvia.sources import paged
from fluvia.streaming import schedule
from tests.fake_layer import ASKED


def test_pages_with_retries(spark):
    spark.dataSource.register(paged.PagedLayer)
    x = spark.read.format("paged_layer").option("layer", "tests.fake_layer:LAYER").option("schema", "id int, name string").option("page", 4).option("partition", 10).load()
    assert sorted(r.id for r in x.collect()) == list(range(25))


def test_comparisons_are_pushed_and_tested_again(spark):
    spark.dataSource.register(paged.PagedLayer)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        log = pathlib.Path(ASKED)
        log.unlink(missing_ok=True)
        x = spark.read.format("paged_layer").option("layer", "tests.fake_layer:LOGGED").option("schema", "id int, name string").option("push", "true").load()
        assert sorted(r.id for r in x.filter("id >= 20 AND name <> 'name 22'").collect()) == [20, 21, 23, 24]
        assert "id >= 20" in log.read_text()
        y = paged.newest_first(spark, "tests.fake_layer:LOGGED", "id int, name string", "id", since=22)
        assert [r.id for r in y.collect()] == [24, 23, 22]
        assert "id DESC" in log.read_text()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_layer_that_grows_while_it_is_read_loses_nothing():
    reader = paged.PagedReader({"layer": "tests.fake_layer:GROWS", "page": "4", "partition": "10"})
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(27))


def test_cache_or_fetch(spark, tmp_path):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "cell int")

    def fetch(batches):
        for b in batches:
            if 3 not in set(b.cell):  # that batch fails
                yield b.assign(rain=b.cell * 1.5)

    path = str(tmp_path / "rain")
    one = paged.fetched_with_cache(wanted.filter("cell < 3"), path, ["cell"], fetch, "cell int, rain double")
    assert {tuple(r) for r in one.collect()} == {(1, 1.5), (2, 3.0)}
    two = paged.fetched_with_cache(wanted, path, ["cell"], fetch, "cell int, rain double")
    assert {tuple(r) for r in two.collect()} == {(1, 1.5), (2, 3.0)}


def test_publish_only_what_was_counted(spark, tmp_path):
    x, path = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), str(tmp_path / "rows.csv")
    assert publish.publish(x, path, 2) == 2 and os.path.isdir(path)
    assert publish.publish(x, path, 3) is None and not os.path.exists(path)
    assert publish.health(rows=x, none=x.limit(0)) == {"rows": {"rows": 2, "ok": True}, "none": {"rows": 0, "ok": False}}


def test_a_schedule_survives_errors():
    seen = []

    def job():
        seen.append(1)
        if len(seen) == 2:
            raise OSError("the feed is down")

    s = schedule.Schedule(job, 0.01, first=0.0, least=0.01).start()
    end = time.time() + 10
    while len(seen) < 4 and time.time() < end:
        time.sleep(0.01)
    s.stop(5)
    assert s.failures == 1 and s.runs >= 2
    assert schedule.Schedule(job, 5).wait == schedule.LEAST_WAIT


def test_best_read_and_missing_cells(spark):
    torn = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    whole = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(r.id for r in paged.best_read([torn, whole], "id").collect()) == [1, 2, 3]
    assert [r.id for r in paged.missing_cells(whole, torn, ["id"]).collect()] == [3]


def test_issue_form(spark):
    x = spark.createDataFrame([("### Name\n\nOld weir\n\n### Where\n\n52.1, -1.2\n",)], "t string")
    assert x.select(paged.issue_form(F.col("t"))).first()[0] == {"Name": "Old weir", "Where": "52.1, -1.2"}


def test_state_first(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    assert paged.state_first("x", str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "a/x")
    assert paged.state_first("y", str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "b/y")


def test_fetched_in_batches(spark, tmp_path):
    """Batches of a few keys, failures by label, retried by the next call; a partitioned cache and its freshness."""
    wanted = spark.createDataFrame([(c, y) for c in ("a", "b", "c", "d", "e") for y in (2022, 2023)] + [("a", 2022)], "cell string, year int").coalesce(1)
    schema, cache = "cell string, year int, rain double, asked int", str(tmp_path / "cache")

    def asker(bad, now):
        def ask(keys):
            assert len(keys) <= 3
            if any(c in bad for c, _ in keys):
                e = OSError("no")
                e.code = 503
                raise e
            return [{"cell": c, "year": y, "rain": float(y), "asked": now} for c, y in keys]

        return ask

    rows, failed = paged.fetched_in_batches(wanted, cache, ["cell", "year"], asker({"c"}, 1), schema, 3, 1, partition_by=("year",))
    lost = {tuple(r)[:2] for r in failed.collect()}
    assert {r.error for r in failed.collect()} == {"HTTP 503"} and {("c", 2022), ("c", 2023)} <= lost and len(lost) < 10
    assert rows.count() == 10 - len(lost) and (tmp_path / "cache" / "year=2022").exists()
    rows, failed = paged.fetched_in_batches(wanted, cache, ["cell", "year"], asker(set(), 2), schema, 3, 1, partition_by=("year",))
    assert failed.isEmpty() and sorted((r.cell, r.year) for r in rows.collect()) == sorted({(r.cell, r.year) for r in wanted.collect()})
    assert {r.asked for r in rows.filter("cell = 'c'").collect()} == {2}
    again, _ = paged.fetched_in_batches(wanted, cache, ["cell", "year"], asker({"a"}, 3), schema, 3, 1, partition_by=("year",))
    assert again.filter("asked = 3").isEmpty()  # all cached
    new, failed = paged.fetched_in_batches(wanted, cache, ["cell", "year"], asker(set(), 9), schema, 3, 1, ("asked", 5), ("year",))
    assert {r.asked for r in new.collect()} == {9} and failed.isEmpty()
    assert paged.fetch_error(ValueError("x")) == "ValueError"
