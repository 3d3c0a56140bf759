"""State that is kept up: retraced networks, alerts, folded polls, tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fluvia.functions import maths as M
from fluvia.operators import graph as G
from fluvia.operators import retrace
from fluvia.plans.base import big, col, lit, query
from fluvia.plans.domain import UP, edges
from fluvia.streaming import alerts


def _new_folder(t, name: str) -> str:
    return f"{G._folder(t.spark)}/fluvia-{name}-{uuid.uuid4().hex[:12]}"


@query("grf_16_retrace", UP + " SELECT root, s_suppkey AS source, dist FROM up JOIN (SELECT s_suppkey, CASE WHEN s_acctbal < -900 THEN s_suppkey // 2 + 1 ELSE s_suppkey END AS place FROM supplier WHERE s_acctbal <= 9500) ON place = node")
def _retraced(t):
    """A table of the sources above each root, brought up to date after some were removed and some moved."""
    roots = t.supplier.select(col("s_suppkey").alias("node"))
    old = t.supplier.select(col("s_suppkey").alias("source"), col("s_suppkey").alias("node"))
    moved = F.when(col("s_acctbal") < -900, F.floor(col("s_suppkey") / 2) + 1).otherwise(col("s_suppkey"))
    new = t.supplier.filter("s_acctbal <= 9500").select(col("s_suppkey").alias("source"), moved.alias("node"))
    path, tile = _new_folder(t, "traced"), F.floor(col("root") / 32)
    retrace.build(edges(t), roots, old, 120.0, path, tile)
    retrace.retrace(edges(t), roots, old, new, 120.0, path, tile)
    return retrace.table(t.spark, path)


#: A level that alerts, and the hours of quiet after an alert. Fixed values.
HIGH, QUIET_H = 80, 20


@query(
    "stm_11_alerts_sent",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM
  (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS before FROM events) WHERE value >= {HIGH} AND before < {HIGH}),
w AS (SELECT user_id, rn, event_id, value, ts AS sent, true AS goes FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.event_id, e.value, CASE WHEN (epoch_us(e.ts) // 1000) - (epoch_us(w.sent) // 1000) >= {QUIET_H * 3600000} THEN e.ts ELSE w.sent END, (epoch_us(e.ts) // 1000) - (epoch_us(w.sent) // 1000) >= {QUIET_H * 3600000}
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, event_id, epoch_us(sent) // 1000 AS at, value AS level FROM w WHERE goes""",
)
def _alerts_sent(t):
    """Rises to the level, the quiet time counted from the alert that was sent."""
    x = t.events.select(col("user_id").alias("key"), F.floor(F.unix_micros(col("ts").cast("timestamp")) / 1000).alias("at"), col("event_id").alias("id"), col("value").alias("level"))
    return alerts.alerts(x, HIGH, QUIET_H).select(col("key").alias("user_id"), col("id").alias("event_id"), big(col("at")).alias("at"), "level")


def _polls(t, week: int):
    """Events of a week as polls: an error is not known, a purchase an event that began."""
    status = F.when(col("event_type") == "error", -1).when(col("event_type") == "purchase", 1).otherwise(0)
    x = t.events.filter((F.floor((F.dayofmonth("ts") - 1) / 7) == week) if week < 3 else (F.floor((F.dayofmonth("ts") - 1) / 7) >= 3))
    start = F.when(col("event_type") == "purchase", F.date_trunc("hour", "ts"))
    return x.select(col("user_id").alias("site_id"), (col("user_id") % 3).alias("company"), status.alias("status"), start.alias("status_start"), col("ts").alias("fetched_at"))


_POLLS = """(SELECT user_id AS site_id, user_id % 3 AS company, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END AS status,
  CASE WHEN event_type = 'purchase' THEN date_trunc('hour', ts) END AS status_start, ts, least((dayofmonth(ts) - 1) // 7, 3) AS batch FROM events)"""


@query(
    "stm_2_four_sinks",
    f"""WITH p AS {_POLLS}, l AS (SELECT max(batch) AS b FROM p),
s AS (SELECT site_id, arg_max(status, (ts, status)) AS status FROM p, l WHERE batch = l.b GROUP BY 1)
SELECT 'snapshot' AS sink, site_id::BIGINT AS key, status::BIGINT AS n FROM s
UNION ALL SELECT 'history', site_id, count(DISTINCT (status, status_start, CASE WHEN status_start IS NULL THEN ts::DATE END)) FROM p GROUP BY 2
UNION ALL SELECT 'coverage', site_id, bit_count(bit_or(CASE WHEN status >= 0 THEN 1::BIGINT << (hour(ts) * 2 + minute(ts) // 30)::INT ELSE 0 END)) FROM p GROUP BY site_id, ts::DATE
UNION ALL SELECT 'polls', company, count(*) FROM p GROUP BY batch, company""",
)
def _four_sinks(t):
    """A month of polls in four batches, one of them replayed: what the four tables hold after the last commit."""
    from fluvia.streaming import folds

    log = folds.live_log(_new_folder(t, "live"), merge_after=2)
    for batch in (0, 1, 1, 2, 3):
        log(_polls(t, batch), batch)
    read = lambda name: log.read(t.spark, name)
    row = lambda df, name, key, n: df.select(lit(name).alias("sink"), big(col(key)).alias("key"), big(n).alias("n"))
    out = row(read("snapshot"), "snapshot", "site_id", col("status")).unionByName(row(read("history").groupBy("site_id").agg(F.count("*").alias("n")), "history", "site_id", col("n")))
    out = out.unionByName(row(read("coverage"), "coverage", "site_id", F.bit_count("slots")))
    return out.unionByName(row(read("polls"), "polls", "company", col("n")))


_BOX = (200.0, 100.0, 420.0, 300.0)
_LX, _LY = "(p_partkey * 37 % 1000)", "(p_partkey * 91 % 1000)"


@query(
    "snk_8_tile_store",
    f"""SELECT l_partkey AS link, l_suppkey AS source, floor(sum(l_quantity) / 10 + 0.5) * 10 AS base, round(floor(avg(l_discount) * 10000 + 0.5) / 10000, 6) AS share
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_LX} BETWEEN 200 AND 420 AND {_LY} BETWEEN 100 AND 300 GROUP BY 1, 2""",
)
def _tile_store(t):
    """Links and what flows into them, written by tiles and read back for one box."""
    from fluvia.sinks import tiles

    path = _new_folder(t, "tiles")
    links = t.part.select(col("p_partkey").alias("link"), F.expr(_LX).cast("double").alias("x"), F.expr(_LY).cast("double").alias("y"), col("p_size").cast("double").alias("upstream"))
    records = t.lineitem.groupBy(col("l_partkey").alias("link"), col("l_suppkey").alias("source")).agg(F.sum("l_quantity").alias("base"), F.avg("l_discount").alias("share"))
    tiles.write(links, records, path, 100.0)
    return tiles.records_in(t.spark, path, 100.0, _BOX).withColumn("share", F.round("share", 6))


@query(
    "ml_7_isotonic_crossfit",
    """WITH c AS (SELECT l_linenumber::BIGINT AS lead, month(l_shipdate) % 2 AS fold, l_discount AS x, count(*) AS w, count_if(l_returnflag = 'R') AS s FROM lineitem GROUP BY ALL),
a AS (SELECT j.lead, j.fold, j.x AS lo, k.x AS hi, sum(m.s) / sum(m.w) AS mean FROM c j JOIN c k ON j.lead = k.lead AND j.fold = k.fold AND j.x <= k.x JOIN c m ON m.lead = j.lead AND m.fold = j.fold AND m.x BETWEEN j.x AND k.x GROUP BY ALL),
f AS (SELECT lead, fold, x, max(least_mean) AS p FROM (SELECT c.lead, c.fold, c.x, a.lo, min(a.mean) AS least_mean FROM c JOIN a ON a.lead = c.lead AND a.fold = c.fold AND a.lo <= c.x AND a.hi >= c.x GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT c.lead, c.fold::BIGINT AS fold, c.x, c.w::BIGINT AS n, round(1e-9 + CASE WHEN lo.x IS NULL THEN hi.p WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.p ELSE lo.p + (c.x - lo.x) * (hi.p - lo.p) / (hi.x - lo.x) END, 6) AS p
FROM c ASOF LEFT JOIN f lo ON lo.lead = c.lead AND lo.fold = 1 - c.fold AND lo.x <= c.x ASOF LEFT JOIN f hi ON hi.lead = c.lead AND hi.fold = 1 - c.fold AND hi.x >= c.x WHERE lo.x IS NOT NULL OR hi.x IS NOT NULL""",
)
def _crossfit(t):
    """Each month's rows by the fit on months of the other parity, for each lead."""
    from fluvia.operators import calibration

    x = t.lineitem.select(big(col("l_linenumber")).alias("lead"), big(F.month("l_shipdate") % 2).alias("fold"), col("l_discount").alias("x"), (col("l_returnflag") == "R").cast("int").alias("y"))
    group = F.concat_ws("/", "lead", "fold")
    table = calibration.knots(calibration.isotonic(x.withColumn("g", group), "g", "x", "y"))
    cells = x.groupBy("lead", "fold", "x").agg(F.count("*").alias("n")).withColumn("g", F.concat_ws("/", "lead", 1 - col("fold")))
    return calibration.calibrated(cells, "g", "x", table).filter("p IS NOT NULL").select("lead", "fold", "x", M.r6(col("p")).alias("p"), "n")


@query(
    "snk_13_merged_reviews",
    """WITH h AS (SELECT o_orderkey AS id, o_custkey AS spot, o_orderpriority AS text FROM orders WHERE o_orderstatus <> 'O'),
n AS (SELECT o_orderkey AS id, o_custkey AS spot, CASE WHEN o_totalprice > 100000 THEN 'changed' END AS text FROM orders WHERE o_orderstatus <> 'F')
SELECT coalesce(n.id, h.id) AS id, coalesce(n.spot, h.spot) AS spot, coalesce(n.text, h.text) AS text, n.id IS NULL AS incomplete
FROM h FULL JOIN n ON n.spot = h.spot AND n.id = h.id WHERE coalesce(n.spot, h.spot) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _merged_reviews(t):
    """A pull that broke off: it adds and changes, what it lacks is held over and marked; only known spots, cached texts stay."""
    from fluvia.operators import merge

    row = lambda df, text: df.select(col("o_custkey").alias("spot"), col("o_orderkey").alias("id"), text.alias("text"))
    held = row(t.orders.filter("o_orderstatus <> 'O'"), col("o_orderpriority"))
    pulled = row(t.orders.filter("o_orderstatus <> 'F'"), F.when(col("o_totalprice") > 100000, "changed"))
    return merge.merged(held, pulled, ["spot", "id"], False, t.customer.filter("c_acctbal > 0").select(col("c_custkey").alias("spot")), ("text",))


@query("eva_3_bootstrap_auc")
def _bootstrap_auc(t):
    """Intervals of the area under the curve and of the Brier score over 2,000 draws of suppliers."""
    from fluvia.operators import bootstrap
    from fluvia.plans.relational import pp, y

    x = bootstrap.auc_draws(t.lineitem.select("l_suppkey", pp().alias("p"), y().alias("y")), "l_suppkey", "p", "y")
    return bootstrap.intervals(x).select("measure", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")])
