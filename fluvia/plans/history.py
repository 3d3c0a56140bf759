"""Observed exposure, lead-aware replays and held-out fits over the whole history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions import maths as M
from fluvia.operators import intervals, regression
from fluvia.operators import temporal as T
from fluvia.plans.base import big, col, lit, query
from fluvia.plans.domain import UP, upstream
from fluvia.plans.relational import R, day

# --- observed exposure: discharge events of the sources above, in the window before each sample ------------------------

#: Hours before arrival in which an event still counts, and of a tenfold decay. Fixed values.
BEFORE_H, T90_H = 48, 30
_EVENTS = """(SELECT o_orderkey, o_custkey AS site, epoch(o_orderdate) / 3600.0 AS began, epoch(greatest(max(l_shipdate), o_orderdate)) / 3600.0 AS ended
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""


_DAY = 86_400_000_000


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def _hours(c):
    return _micros(c) / 3_600_000_000


def _events(t):
    """site, began, ended (hours): an order's site discharges from its date to its last line's."""
    last = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return t.orders.join(last, "o_orderkey").select("o_orderkey", col("o_custkey").alias("site"), _hours(col("o_orderdate")).alias("began"), _hours(F.greatest("last", "o_orderdate")).alias("ended"))


@query(
    "eva_8_observed_exposure",
    f"""{UP}, ev AS {_EVENTS}, s AS (SELECT o_orderkey, node AS site, dist, epoch(o_orderdate) / 3600.0 - dist AS arrive FROM orders JOIN up ON root = o_custkey),
l AS (SELECT s.o_orderkey, s.site, dist, arrive, max(ended) AS last FROM s LEFT JOIN ev ON ev.site = s.site AND began <= arrive AND ended >= arrive - {BEFORE_H} GROUP BY ALL)
SELECT o_orderkey, count(*)::BIGINT AS sources, count(last)::BIGINT AS active, {R(f"1 - product(1 - CASE WHEN last IS NULL THEN 0 ELSE least(1.0, 5000 / (dist + 5000)) * pow(10, -greatest(0, arrive - last) / {T90_H}.0) END)")} AS exposure FROM l GROUP BY 1""",
)
def _observed_exposure(t):
    """Samples (orders of the roots' sites): what each source above sent, by the end of its latest event that could still arrive."""
    up = upstream(t).select(col("root").alias("o_custkey"), col("node").alias("site"), "dist")
    s = t.orders.select("o_orderkey", "o_custkey", _hours(col("o_orderdate")).alias("at")).join(up, "o_custkey")
    s = s.select("o_orderkey", "site", "dist", (col("at") - col("dist")).alias("arrive")).withColumn("since", col("arrive") - BEFORE_H)
    x = intervals.latest_end(s, _events(t).drop("o_orderkey"), ["site"], "since", "arrive", "began", "ended", 24.0 * 30)
    # greatest() passes over nulls: a source without an event sends nothing
    share = F.when(col("last").isNotNull(), F.least(lit(1.0), lit(5000.0) / (col("dist") + 5000)) * M.decay(F.greatest(col("arrive") - col("last"), lit(0.0)), T90_H))
    return x.groupBy("o_orderkey").agg(F.count("*").alias("sources"), F.count("last").alias("active"), M.r6(1 - F.product(1 - F.coalesce(share, lit(0.0)))).alias("exposure"))


@query(
    "eva_8_overlaps",
    f"""WITH ev AS {_EVENTS} SELECT o.o_orderkey, count(ev.o_orderkey)::BIGINT AS n, {R("sum(least(ended, epoch(o_orderdate) / 3600.0) - greatest(began, epoch(o_orderdate) / 3600.0 - 720))")} AS hours
FROM orders o JOIN ev ON ev.site = o.o_custkey AND began <= epoch(o_orderdate) / 3600.0 AND ended >= epoch(o_orderdate) / 3600.0 - 720 AND ev.o_orderkey <> o.o_orderkey GROUP BY 1""",
)
def _overlaps(t):
    """Of each sample: the other events of its site in the 30 days before, and their hours in that window."""
    last = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"), F.count("*").alias("lines"))
    x = t.orders.filter("o_orderkey IS NOT NULL").select("o_orderkey", col("o_custkey").alias("site"), "o_orderdate").join(last, "o_orderkey", "left")
    x = x.select("o_orderkey", "site", _micros(col("o_orderdate")).alias("hi"), F.when(col("lines").isNotNull(), _micros(F.greatest("last", "o_orderdate"))).alias("ended")).withColumn("lo", col("hi") - 30 * _DAY)
    # its own event is among those that it meets: the order's key has one row
    own = F.filter(F.collect_list(F.struct(col("hi").alias("began"), "ended")).over(Window.partitionBy("o_orderkey", "site")), lambda e: (e["began"] <= col("hi")) & (e["ended"] >= col("lo")))
    s = x.select("o_orderkey", "site", "lo", "hi", own.alias("own"))
    s = s.select("o_orderkey", "site", "lo", "hi", F.size("own").cast("long").alias("n_own"), F.aggregate("own", lit(0).cast("long"), lambda a, e: a + F.least(e["ended"], col("hi")) - F.greatest(e["began"], col("lo"))).alias("own"))
    events = x.select("site", col("hi").alias("began"), "ended")
    y = intervals.overlap_totals(s, events, ["site"], ["o_orderkey"], "lo", "hi", "began", "ended", 365 * _DAY)
    return y.filter("n > n_own").select("o_orderkey", (col("n") - col("n_own")).alias("n"), M.r6((col("total") - col("own")).cast("double") / 3_600_000_000).alias("hours"))


# --- lead-aware shift and its replay ---------------------------------------------------------------------------------

_VALUES = "(SELECT l_suppkey AS site, l_shipdate::DATE AS day, l_linenumber - 1 AS lead, avg(CASE WHEN l_tax > 0.02 THEN least(l_discount * 8, 1) END) AS p FROM lineitem GROUP BY ALL)"
_SOURCES = "(SELECT s_nationkey AS root, s_suppkey AS site, 0.2 + s_suppkey % 5 * 0.1 AS weight, (s_suppkey % 70)::DOUBLE AS h FROM supplier)"
_LEGS = f"(SELECT root, site, weight, floor(h / 24)::INT + e AS late, CASE WHEN e = 0 THEN 1 - (h / 24 - floor(h / 24)) ELSE h / 24 - floor(h / 24) END AS share FROM {_SOURCES}, unnest([0, 1]) u(e))"


def _shift_sql(leads: str) -> str:
    return f"""WITH e AS (SELECT k, root, site, weight, (day + late)::DATE AS day, sum(share * coalesce(p, 0)) AS x, sum(CASE WHEN p IS NULL THEN share ELSE 0 END) AS gone
FROM {_LEGS} JOIN {_VALUES} USING (site), unnest({leads}) u(k) WHERE share > 0 AND lead = greatest(k - late, 0) GROUP BY ALL),
f AS (SELECT k, root, day, 1 - product(1 - least(greatest(x, 0), 1) * weight) AS exposure, least(sum(gone * weight) / total, 1) AS missing
FROM e JOIN (SELECT root, sum(weight) AS total FROM {_SOURCES} GROUP BY 1) USING (root) GROUP BY k, root, day, total)"""


def _leads(t, k: int) -> DataFrame:
    p = F.avg(F.when(col("l_tax") > 0.02, F.least(col("l_discount") * 8, lit(1.0))))
    values = t.lineitem.groupBy(col("l_suppkey").alias("site"), day("l_shipdate").alias("day"), (col("l_linenumber") - 1).alias("lead")).agg(p.alias("p"))
    sources = t.supplier.select(col("s_nationkey").alias("root"), col("s_suppkey").alias("site"), (0.2 + col("s_suppkey") % 5 * 0.1).alias("weight"), (col("s_suppkey") % 70).cast("double").alias("travel_h"))
    return T.lead_shift(sources, values, k)


query("win_16_lead_aware_shift", _shift_sql("[3]") + f" SELECT root, day, {R('exposure')} AS exposure, {R('missing')} AS missing FROM f")(
    lambda t: _leads(t, 3).select("root", "day", M.r6(col("exposure")).alias("exposure"), M.r6(col("missing")).alias("missing"))
)


@query(
    "eva_9_exposure_replay",
    _shift_sql("[0, 1, 2, 3]")
    + f""", y AS (SELECT s_nationkey AS root, l_shipdate::DATE AS day, max((l_returnflag = 'R')::INT) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT k::BIGINT AS lead, count(*)::BIGINT AS n, {R("avg(pow(exposure - y, 2))")} AS brier, {R("avg(missing)")} AS missing, {R("avg(y)")} AS rate FROM f JOIN y USING (root, day) GROUP BY 1""",
)
def _replay(t):
    """Each lead's exposure, from what was forecast at that lead, against what was seen."""
    y = t.lineitem.select(col("l_suppkey").alias("s_suppkey"), day("l_shipdate").alias("day"), (col("l_returnflag") == "R").cast("int").alias("y"))
    y = y.join(t.supplier.select("s_suppkey", col("s_nationkey").alias("root")), "s_suppkey").groupBy("root", "day").agg(F.max("y").alias("y"))
    x = reduce(DataFrame.unionByName, (_leads(t, k).withColumn("lead", lit(k)) for k in range(4))).join(y, ["root", "day"])
    return x.groupBy(big(col("lead")).alias("lead")).agg(F.count("*").alias("n"), M.r6(F.avg(F.pow(col("exposure") - col("y"), lit(2.0)))).alias("brier"), M.r6(F.avg("missing")).alias("missing"), M.r6(F.avg("y")).alias("rate"))


# --- held-out years ---------------------------------------------------------------------------------------------------


@query(
    "eva_2_leave_one_year_out",
    f"""WITH d AS (SELECT l_suppkey AS site, year(l_shipdate) AS yr, l_quantity AS x, l_extendedprice AS y FROM lineitem),
tr AS (SELECT h.yr AS held, d.* FROM (SELECT DISTINCT yr FROM d) h JOIN d ON d.yr <> h.yr), m AS (SELECT held, site, avg(x) AS mx, avg(y) AS my FROM tr GROUP BY 1, 2),
b AS (SELECT held, count(*) AS n, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS beta FROM tr JOIN m USING (held, site) GROUP BY 1 HAVING count(*) >= 50)
SELECT b.held::BIGINT AS year, n::BIGINT AS n, {R("beta")} AS slope, count(*)::BIGINT AS held_out, {R("sqrt(avg(pow(y - my - beta * (x - mx), 2)))")} AS rmse
FROM b JOIN d ON d.yr = b.held JOIN m ON m.held = b.held AND m.site = d.site GROUP BY ALL""",
)
def _held_out_years(t):
    """Price on quantity within each site, every year held out in turn: slope of the other years and error on the year itself."""
    d = t.lineitem.select(col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), col("l_quantity").alias("x"), col("l_extendedprice").alias("y"))
    fits, rows = regression.leave_one_out(d, "site", "year", ["x"], "y")
    error = rows.filter("level IS NOT NULL").groupBy("year").agg(F.count("*").alias("held_out"), M.r6(F.sqrt(F.avg(F.pow(col("y") - col("level"), lit(2.0))))).alias("rmse"))
    return fits.join(error, "year").select(big(col("year")).alias("year"), "n", M.r6(col("b_x")).alias("slope"), "held_out", "rmse")
