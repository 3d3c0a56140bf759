"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvia.functions import maths as M
from fluvia.operators import companions
from fluvia.operators import temporal as T
from fluvia.plans.base import big, col, lit, query

R = lambda s: f"round({s} + 1e-9, 6)"
day = lambda c: F.to_date(c)

# --- rain: hourly series of `events` -----------------------------------------------------------------------------

#: One row per cell and hour, the last by (ts, event_id); errors are unknown, not zero.
HOURLY = """(SELECT user_id AS cell, hr, mm FROM (SELECT user_id, date_trunc('hour', ts) AS hr, CASE WHEN event_type <> 'error' THEN value END AS mm,
  row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def hourly(t, when: str = "true"):
    x = t.events.filter(when).select(col("user_id").alias("cell"), F.date_trunc("hour", "ts").alias("hr"), "ts", "event_id", F.when(col("event_type") != "error", col("value")).alias("mm"))
    return T.latest_per(x, ["cell", "hr"], [col("ts").desc(), col("event_id").desc()]).select("cell", "hr", "mm")


#: A day's rain to six decimals: the order of a sum must not decide on which side of a limit or of a half it lies.
DAILY = f"(SELECT cell, hr::DATE AS day, {R('sum(mm)')} AS rain, max(mm) AS top, count(mm)::BIGINT AS n_hours FROM {HOURLY} GROUP BY cell, hr::DATE)"


def daily(t, when: str = "true"):
    return hourly(t, when).groupBy("cell", day("hr").alias("day")).agg(M.r6(F.sum("mm")).alias("rain"), F.max("mm").alias("top"), F.count("mm").alias("n_hours"))


DENSE = f"(SELECT g.cell, g.day, d.rain FROM (SELECT cell, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {DAILY} GROUP BY cell) g LEFT JOIN {DAILY} d ON g.cell = d.cell AND g.day = d.day)"


def dense(t):
    return T.densify_days(daily(t).select("cell", "day", "rain"), ["cell"], "day")


query("srt_1_last_per_hour", f"SELECT cell, strftime(hr, '%Y-%m-%d %H') AS hr, mm FROM {HOURLY}")(lambda t: hourly(t).select("cell", F.date_format("hr", "yyyy-MM-dd HH").alias("hr"), "mm"))
query("agg_1_daily_rain", f"SELECT cell, day, CASE WHEN n_hours >= 2 THEN {R('rain')} END AS rain, CASE WHEN n_hours >= 2 THEN top END AS top, n_hours FROM {DAILY}")(lambda t: daily(t).select("cell", "day", F.when(col("n_hours") >= 2, M.r6(col("rain"))).alias("rain"), F.when(col("n_hours") >= 2, col("top")).alias("top"), "n_hours"))
query("win_1_rolling_hours", f"SELECT cell, strftime(hr, '%Y-%m-%d %H') AS hr, {R('sum(mm) OVER (PARTITION BY cell ORDER BY hr ROWS 2 PRECEDING)')} AS r3, {R('sum(mm) OVER (PARTITION BY cell ORDER BY hr ROWS 5 PRECEDING)')} AS r6 FROM {HOURLY}")(
    lambda t: hourly(t).select("cell", F.date_format("hr", "yyyy-MM-dd HH").alias("hr"), *[M.r6(F.sum("mm").over(Window.partitionBy("cell").orderBy("hr").rowsBetween(-n + 1, 0))).alias(f"r{n}") for n in (3, 6)])
)
_wd = lambda: Window.partitionBy("cell").orderBy("day")
query("win_2_lags", f"SELECT cell, day, {R('lag(rain) OVER w')} AS d1, {R('lag(rain, 2) OVER w')} AS d2 FROM {DENSE} WINDOW w AS (PARTITION BY cell ORDER BY day)")(lambda t: dense(t).select("cell", "day", M.r6(F.lag("rain").over(_wd())).alias("d1"), M.r6(F.lag("rain", 2).over(_wd())).alias("d2")))
query("win_3_rolling_days", f"SELECT cell, day, {', '.join(R(f'sum(rain) OVER (PARTITION BY cell ORDER BY day ROWS {n - 1} PRECEDING)') + f' AS r{n}' for n in (3, 7, 30))} FROM {DENSE}")(lambda t: dense(t).select("cell", "day", *[M.r6(F.sum("rain").over(_wd().rowsBetween(-n + 1, 0))).alias(f"r{n}") for n in (3, 7, 30)]))
query("win_4_decay_index", f"SELECT a.cell, a.day, {R('sum(coalesce(b.rain, 0) * pow(0.85, a.day - b.day))')} AS api FROM {DENSE} a JOIN {DENSE} b ON a.cell = b.cell AND b.day <= a.day GROUP BY a.cell, a.day")(lambda t: T.decay_index(dense(t), ["cell"], "day", "rain").withColumn("api", M.r6(col("api"))))
query("win_5_densify", f"SELECT cell, day, {R('rain')} AS rain FROM {DENSE}")(lambda t: dense(t).withColumn("rain", M.r6(col("rain"))))
query("win_6_rank_capture", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn <= n * 0.5")(
    lambda t: t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(col("o_totalprice").desc(), "o_orderkey")).alias("rn"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n")).filter("rn <= n * 0.5").select("o_custkey", "o_orderkey")
)
_AR = "(rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0)"
query("win_7_spearman", f"SELECT l_returnflag, {R('corr(a, b)')} AS rho FROM (SELECT l_returnflag, {_AR.format('l_quantity')} AS a, {_AR.format('l_tax')} AS b FROM lineitem) GROUP BY l_returnflag")(
    lambda t: T.average_rank(T.average_rank(t.lineitem.select("l_returnflag", "l_quantity", "l_tax"), "l_quantity", "a", ["l_returnflag"]), "l_tax", "b", ["l_returnflag"]).groupBy("l_returnflag").agg(M.r6(F.corr("a", "b")).alias("rho"))
)
query("win_8_auc", f"SELECT l_linestatus, {R('(sum(CASE WHEN y THEN r END) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * sum((NOT y)::INT))')} AS auc FROM (SELECT l_linestatus, l_returnflag = 'R' AS y, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY l_linestatus")(
    lambda t: T.average_rank(t.lineitem.select("l_linestatus", "l_quantity", (col("l_returnflag") == "R").alias("y")), "l_quantity", "r", ["l_linestatus"]).groupBy("l_linestatus").agg(F.sum(F.when(col("y"), col("r"))).alias("s"), F.count_if("y").alias("n1"), F.count_if(~col("y")).alias("n0")).select("l_linestatus", M.r6((col("s") - col("n1") * (col("n1") + 1) / 2) / (col("n1") * col("n0"))).alias("auc"))
)
query("win_9_decision_rows", "SELECT l_suppkey, l_shipdate::DATE AS day, l_orderkey, l_linenumber::BIGINT AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY (l_tax <= 0.04) DESC, CASE WHEN l_tax <= 0.04 THEN l_quantity END DESC NULLS LAST, l_quantity, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")(
    lambda t: T.latest_per(t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_tax", "l_quantity", "l_extendedprice"), ["l_suppkey", "l_shipdate"], [(col("l_tax") <= 0.04).desc(), F.when(col("l_tax") <= 0.04, col("l_quantity")).desc_nulls_last(), col("l_quantity"), col("l_orderkey"), col("l_linenumber"), col("l_extendedprice")]).select("l_suppkey", day("l_shipdate").alias("day"), "l_orderkey", big(col("l_linenumber")).alias("line"))
)
query("win_10_demean", f"SELECT o_orderkey, {R('o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)')} AS x FROM orders")(lambda t: t.orders.select("o_orderkey", M.r6(col("o_totalprice") - F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))).alias("x")))
_SLOTS = "(SELECT DISTINCT user_id, ts::DATE AS day, hour(ts) * 2 + minute(ts) // 30 AS s FROM events)"


def slots(t):
    return t.events.select("user_id", day("ts").alias("day"), (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("bigint").alias("s")).distinct()


query("win_11_longest_gap", f"SELECT user_id, day, greatest(max((s - p) * 0.5), min(s) * 0.5, (47 - max(s)) * 0.5)::DOUBLE AS gap_h FROM (SELECT *, lag(s) OVER (PARTITION BY user_id, day ORDER BY s) AS p FROM {_SLOTS}) GROUP BY user_id, day")(
    lambda t: slots(t).groupBy("user_id", "day").agg(F.sort_array(F.collect_list("s")).alias("x")).select("user_id", "day", F.greatest(F.array_max(F.zip_with(F.slice("x", lit(2), F.size("x") - 1), F.slice("x", lit(1), F.size("x") - 1), lambda b, a: (b - a) * 0.5)), F.array_min("x") * 0.5, (47 - F.array_max("x")) * 0.5).cast("double").alias("gap_h"))
)
query("win_12_first_last_slot", f"SELECT user_id, day, (min(s) * 0.5)::DOUBLE AS first_h, ((max(s) + 1) * 0.5)::DOUBLE AS last_h FROM {_SLOTS} GROUP BY user_id, day")(lambda t: slots(t).groupBy("user_id", "day").agg((F.min("s") * 0.5).cast("double").alias("first_h"), ((F.max("s") + 1) * 0.5).cast("double").alias("last_h")))
@query(
    "win_13_rise",
    f"""SELECT cell, strftime(hr, '%Y-%m-%d %H') AS hr, CASE WHEN count(*) OVER w >= 2 AND hr - min(hr) OVER w >= INTERVAL 1 HOUR THEN {R("mm - first_value(mm) OVER w")} END AS rise
FROM {HOURLY} WHERE mm IS NOT NULL WINDOW w AS (PARTITION BY cell ORDER BY hr RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def _rise(t):
    """Each reading less the first of the six hours before it; null where they hold less than two readings an hour apart."""
    x = hourly(t).filter("mm IS NOT NULL").withColumn("s", F.unix_micros(col("hr").cast("timestamp")))
    w = Window.partitionBy("cell").orderBy("s").rangeBetween(-6 * 3_600_000_000, 0)
    enough = (F.count("*").over(w) >= 2) & (col("s") - F.min("s").over(w) >= 3_600_000_000)
    return x.select("cell", F.date_format("hr", "yyyy-MM-dd HH").alias("hr"), F.when(enough, M.r6(col("mm") - F.first("mm").over(w))).alias("rise"))


query("win_14_window_totals", f"SELECT s.cell, s.day, {R('sum(h.mm)')} AS r48, count(h.mm)::BIGINT AS n FROM (SELECT DISTINCT cell, hr::DATE AS day FROM {HOURLY}) s JOIN {HOURLY} h ON s.cell = h.cell AND h.hr > s.day + INTERVAL 12 HOUR - INTERVAL 48 HOUR AND h.hr <= s.day + INTERVAL 12 HOUR GROUP BY s.cell, s.day")(
    lambda t: hourly(t).withColumn("day", F.explode(F.sequence(F.to_date(col("hr") - F.expr("INTERVAL 13 HOURS")), F.to_date(col("hr") + F.expr("INTERVAL 36 HOURS"))))).filter("hr > day + INTERVAL 12 HOURS - INTERVAL 48 HOURS AND hr <= day + INTERVAL 12 HOURS").groupBy("cell", "day").agg(M.r6(F.sum("mm")).alias("r48"), F.count("mm").alias("n")).join(hourly(t).select("cell", day("hr").alias("day")).distinct(), ["cell", "day"], "left_semi")
)
_LI = "(SELECT l_suppkey AS site, l_shipdate::DATE AS day, l_quantity * 2 AS h, sum(l_discount) AS p FROM lineitem GROUP BY ALL)"
query("win_15_travel_shift", f"SELECT site, (day + floor(h / 24)::INT + k)::DATE AS day, {R('sum(p * CASE WHEN k = 0 THEN 1 - (h / 24 - floor(h / 24)) ELSE h / 24 - floor(h / 24) END)')} AS p FROM {_LI}, unnest([0, 1]) u(k) GROUP BY 1, 2")(
    lambda t: T.travel_shift(t.lineitem.select(col("l_suppkey").alias("site"), day("l_shipdate").alias("day"), (col("l_quantity") * 2).alias("h"), col("l_discount").alias("p")), "day", "h", "p", ["site"], 1 + t.lineitem.count() // T.ROWS_A_TASK).withColumn("p", M.r6(col("p")))
)
query("win_16_lead_shift", f"SELECT o_custkey, greatest(date_diff('day', o_orderdate::DATE, DATE '1998-01-05'), 0)::BIGINT AS lead, {R('sum(o_totalprice)')} AS v FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1, 2")(lambda t: t.orders.filter("o_orderdate >= '1998-01-01'").groupBy("o_custkey", big(F.greatest(F.datediff(lit("1998-01-05").cast("date"), "o_orderdate"), lit(0))).alias("lead")).agg(M.r6(F.sum("o_totalprice")).alias("v")))
query("win_17_risen", "SELECT event_id FROM (SELECT event_id, value, ts, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value >= 50 AND before < 50")(lambda t: t.events.select("event_id", "value", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).filter("value >= 50 AND before < 50").select("event_id"))
query("win_18_worst_first", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax >= l_discount AND l_tax >= l_quantity / 1000 THEN 'now' WHEN l_discount >= l_quantity / 1000 THEN 'today' ELSE 'tomorrow' END AS worst FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.array_max(F.array(F.struct(col("l_tax").alias("r"), lit(3).alias("o"), lit("now").alias("w")), F.struct(col("l_discount").alias("r"), lit(2).alias("o"), lit("today").alias("w")), F.struct((col("l_quantity") / 1000).alias("r"), lit(1).alias("o"), lit("tomorrow").alias("w"))))["w"].alias("worst"))
)

# --- joins -------------------------------------------------------------------------------------------------------

query("jon_1_full_outer", "SELECT coalesce(c_nationkey, s_nationkey)::BIGINT AS nation, n, m FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS m FROM supplier WHERE s_nationkey > 5 GROUP BY 1) ON c_nationkey = s_nationkey")(
    lambda t: t.customer.filter("c_nationkey < 15").groupBy(col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).join(t.supplier.filter("s_nationkey > 5").groupBy(col("s_nationkey").alias("nation")).agg(F.count("*").alias("m")), "nation", "full").withColumn("nation", big(col("nation")))
)
query("jon_2_sites_x_days", "SELECT s_suppkey, day::DATE AS day FROM supplier, generate_series(DATE '2024-01-01', DATE '2024-01-05', INTERVAL 1 DAY) g(day)")(lambda t: t.supplier.select("s_suppkey", F.explode(F.sequence(lit("2024-01-01").cast("date"), lit("2024-01-05").cast("date"))).alias("day")))
query("jon_3_cell_day_join", f"SELECT e.event_id, {R('d.rain')} AS rain FROM events e LEFT JOIN {DAILY} d ON e.user_id = d.cell AND e.ts::DATE = d.day")(lambda t: t.events.select("event_id", col("user_id").alias("cell"), day("ts").alias("day")).join(daily(t), ["cell", "day"], "left").select("event_id", M.r6(col("rain")).alias("rain")))
query("jon_4_label_join", "SELECT d.doc_id, coalesce(l.toxic, 0)::BIGINT AS y FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", big(F.coalesce("toxic", lit(0))).alias("y")))
query("jon_5_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(lambda t: t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 400000").select(col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"))
query("jon_6_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda t: t.customer.select("c_custkey").join(t.orders.select(col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"))
query("jon_7_covered_minus_stale", "SELECT DISTINCT user_id, ts::DATE AS day FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.ts::DATE = e.ts::DATE AND x.event_type = 'error')")(lambda t: t.events.select("user_id", day("ts").alias("day")).distinct().join(t.events.filter("event_type = 'error'").select("user_id", day("ts").alias("day")), ["user_id", "day"], "left_anti"))
_DC = "(SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)"
query("jon_8_next_day", f"SELECT a.user_id, a.day, coalesce(b.n, 0)::BIGINT AS n_next FROM {_DC} a LEFT JOIN {_DC} b ON a.user_id = b.user_id AND b.day = a.day + 1")(
    lambda t: (x := t.events.groupBy("user_id", day("ts").alias("day")).agg(F.count("*").alias("n"))).select("user_id", "day", F.coalesce(F.when(F.datediff(F.lead("day").over(Window.partitionBy("user_id").orderBy("day")), "day") == 1, F.lead("n").over(Window.partitionBy("user_id").orderBy("day"))), lit(0)).cast("bigint").alias("n_next"))
)
_PRED = "(SELECT user_id, ts, max(event_id) AS pid FROM events WHERE event_type = 'view' GROUP BY 1, 2)"
query("jon_9_asof_validity", f"SELECT e.event_id, arg_max(p.pid, p.ts) AS pid FROM (SELECT * FROM events WHERE event_type = 'purchase' OR event_type = 'signup') e JOIN {_PRED} p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.ts + INTERVAL 12 HOUR > e.ts GROUP BY e.event_id")(
    lambda t: T.asof_join(t.events.filter("event_type IN ('purchase', 'signup')").select("event_id", "user_id", "ts"), t.events.filter("event_type = 'view'").groupBy("user_id", col("ts").alias("pts")).agg(F.max("event_id").alias("pid")).withColumn("expires", col("pts") + F.expr("INTERVAL 12 HOURS")), ["user_id"], "ts", "pts", strict=False, until="expires").filter("pid IS NOT NULL").select("event_id", "pid")
)
query("jon_10_asof_strict", f"SELECT e.event_id, arg_max(p.pid, p.ts) AS pid FROM events e LEFT JOIN {_PRED} p ON p.user_id = e.user_id AND p.ts < e.ts GROUP BY e.event_id")(
    lambda t: T.asof_join(t.events.select("event_id", "user_id", "ts"), t.events.filter("event_type = 'view'").groupBy("user_id", col("ts").alias("pts")).agg(F.max("event_id").alias("pid")), ["user_id"], "ts", "pts").select("event_id", "pid")
)
@query("jon_11_coordinate_key", "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS n FROM (SELECT s_suppkey, round(s_suppkey % 90 / 10.0, 4) AS k FROM supplier)")
def _same_place(t):
    """Rows that share a rounded coordinate, as the first of their group and its size, so that rows grow with the input and not with its square."""
    k = t.supplier.select("s_suppkey", F.rint((col("s_suppkey") % 90) / 10 * 10000).cast("bigint").alias("k"))
    return k.join(k.groupBy("k").agg(F.min("s_suppkey").alias("first"), F.count("*").alias("n")), "k").select("s_suppkey", "first", "n")


query("jon_12_map_fallback", "SELECT c_custkey, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")(lambda t: t.customer.join(t.nation, col("c_nationkey") == col("n_nationkey"), "left").join(t.region.filter("r_regionkey < 3"), col("n_regionkey") == col("r_regionkey"), "left").select("c_custkey", F.coalesce("r_name", lit("none")).alias("region")))
query("jon_13_two_keys", "SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(a.p_name, b.p_name) AS name FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey AND a.p_size > 25 LEFT JOIN part b ON b.p_partkey = l_suppkey")(
    lambda t: t.lineitem.join(t.part.filter("p_size > 25").select(col("p_partkey").alias("l_partkey"), col("p_name").alias("n1")), "l_partkey", "left").join(t.part.select(col("p_partkey").alias("l_suppkey"), col("p_name").alias("n2")), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce("n1", "n2").alias("name"))
)
query("jon_18_id_cascade", "SELECT s_suppkey, coalesce(a.k, b.k) AS c_custkey, CASE WHEN a.k IS NOT NULL THEN 'segment' WHEN b.k IS NOT NULL THEN 'nation' END AS id_source FROM supplier LEFT JOIN (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2 HAVING count(*) = 10) a ON a.c_nationkey = s_nationkey AND a.c_mktsegment = 'BUILDING' LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer WHERE c_acctbal < 0 GROUP BY 1 HAVING count(DISTINCT c_custkey) < 8) b ON b.c_nationkey = s_nationkey")(
    lambda t: t.supplier.select("s_suppkey", col("s_nationkey").alias("c_nationkey")).join(t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("ka"), F.count("*").alias("n")).filter("n = 10 AND c_mktsegment = 'BUILDING'").select("c_nationkey", "ka"), "c_nationkey", "left").join(t.customer.filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.min("c_custkey").alias("kb"), F.countDistinct("c_custkey").alias("n")).filter("n < 8").select("c_nationkey", "kb"), "c_nationkey", "left").select("s_suppkey", F.coalesce("ka", "kb").alias("c_custkey"), F.when(col("ka").isNotNull(), "segment").when(col("kb").isNotNull(), "nation").alias("id_source"))
)
query("jon_19_lead_features", f"SELECT a.cell, a.day, {R('a.rain')} AS d0, {R('b.rain')} AS d1, {R('c.rain')} AS d2 FROM {DAILY} a LEFT JOIN {DAILY} b ON a.cell = b.cell AND b.day = a.day - 1 LEFT JOIN {DAILY} c ON a.cell = c.cell AND c.day = a.day - 2")(
    lambda t: (x := daily(t).select("cell", "day", F.explode(F.array(lit(0), lit(1), lit(2))).alias("k"), "rain")).groupBy("cell", F.date_add("day", col("k")).alias("day")).agg(*[M.r6(F.max(F.when(col("k") == k, col("rain")))).alias(f"d{k}") for k in range(3)], F.count_if(col("k") == 0).alias("n")).filter("n = 1").drop("n")
)
query("jon_20_co_observation", "SELECT a AS user_a, arg_max(b, (n, -b)) AS user_b FROM (SELECT x.user_id AS a, y.user_id AS b, count(*) AS n FROM events x JOIN events y ON date_trunc('hour', x.ts) = date_trunc('hour', y.ts) AND x.event_type = y.event_type AND x.user_id <> y.user_id GROUP BY 1, 2) GROUP BY 1")(
    lambda t: companions.most_frequent(t.events.groupBy("user_id", F.unix_seconds(F.date_trunc("hour", "ts")).alias("h"), "event_type").agg(F.count("*").alias("m")), "user_id", "event_type", "h", "m").withColumnsRenamed({"user_id": "user_a", "other": "user_b"})
)
query("jon_21_aligned", "SELECT o_custkey, count(*)::BIGINT AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")))

# --- aggregates --------------------------------------------------------------------------------------------------

Y, PP = "(l_returnflag = 'R')::INT", "(l_discount * 8 + 0.05)"
y = lambda: (col("l_returnflag") == "R").cast("int")
pp = lambda: col("l_discount") * 8 + 0.05
query("agg_2_group_or", f"SELECT user_id, bit_or(1::BIGINT << s::INT) AS slots, count(*)::BIGINT AS n FROM {_SLOTS} GROUP BY user_id")(lambda t: slots(t).groupBy("user_id").agg(F.bit_or(F.call_function("shiftleft", lit(1).cast("bigint"), col("s").cast("int"))).alias("slots"), F.count("*").alias("n")))
query("agg_3_min_age", f"SELECT (user_id % 3)::BIGINT AS company, {R('min(epoch_us(TIMESTAMP \'2024-02-01\') - epoch_us(ts)) / 3.6e9')} AS age_h FROM events GROUP BY 1")(lambda t: t.events.groupBy((col("user_id") % 3).alias("company")).agg(M.r6(F.min(F.unix_micros(F.to_timestamp(lit("2024-02-01"))) - F.unix_micros(col("ts").cast("timestamp"))) / 3.6e9).alias("age_h")))
query("agg_4_poll_log", "SELECT n_nationkey::BIGINT AS company, coalesce(n, 0)::BIGINT AS n_rows FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")(lambda t: t.nation.select(col("n_nationkey").alias("c_nationkey")).join(t.customer.filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey", "left").select(big(col("c_nationkey")).alias("company"), F.coalesce("n", lit(0)).cast("bigint").alias("n_rows")))
query("agg_5_last_non_null", "SELECT user_id, arg_max(value, ts) FILTER (event_type <> 'error') AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")(lambda t: T.last_non_null(t.events.select("user_id", "ts", F.when(col("event_type") != "error", col("value")).alias("value"), "event_type"), ["user_id"], "ts", ["value", "event_type"]))
_MED = "(SELECT c_custkey, c_nationkey, coalesce(v, median(v) OVER (PARTITION BY c_nationkey)) AS v1 FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer))"
query("agg_6_median_fill", f"SELECT c_custkey, {R(f'coalesce(v1, (SELECT median(v1) FROM {_MED}), 20)')} AS v FROM {_MED}")(lambda t: _median_fill(t))


def _median_fill(t):
    x = t.customer.select("c_custkey", "c_nationkey", F.when(col("c_acctbal") >= 0, col("c_acctbal")).alias("v"))
    by = x.groupBy("c_nationkey").agg(F.median("v").alias("m"))
    x = x.join(by, "c_nationkey").select("c_custkey", F.coalesce("v", "m").alias("v1"))
    whole = x.agg(F.median("v1").alias("g"))  # one row
    return x.crossJoin(F.broadcast(whole)).select("c_custkey", M.r6(F.coalesce("v1", "g", lit(20.0))).alias("v"))


query("agg_7_log_ratio", f"SELECT l_suppkey, {R(f'ln((sum({Y}) + 15) / (sum({PP}) + 15))')} AS off FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(M.r6(F.log((F.sum(y()) + 15) / (F.sum(pp()) + 15))).alias("off")))
query("agg_8_noisy_or", f"SELECT l_suppkey, {R('1 - product(1 - l_discount * 0.1)')} AS risk FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(M.r6(M.noisy_or(col("l_discount") * 0.1)).alias("risk")))
query("agg_9_missing_share", f"SELECT l_suppkey, {R('CASE WHEN sum(l_tax) <= 0 THEN 0 ELSE sum(CASE WHEN l_returnflag = \'N\' THEN l_tax ELSE 0 END) / sum(l_tax) END')} AS share FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(M.r6(F.when(F.sum("l_tax") <= 0, 0.0).otherwise(F.sum(F.when(col("l_returnflag") == "N", col("l_tax")).otherwise(0.0)) / F.sum("l_tax"))).alias("share")))
query("agg_10_status_counts", "SELECT user_id, count_if(event_type = 'error')::BIGINT AS discharging, count_if(event_type IN ('view', 'click'))::BIGINT AS known, count_if(event_type = 'signup')::BIGINT AS offline FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.count_if(col("event_type") == "error").alias("discharging"), F.count_if(col("event_type").isin("view", "click")).alias("known"), F.count_if(col("event_type") == "signup").alias("offline")))
query("agg_11_feed_down", "SELECT (user_id % 3)::BIGINT AS company, count(*)::BIGINT AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since FROM events WHERE event_type = 'signup' GROUP BY 1")(lambda t: t.events.filter("event_type = 'signup'").groupBy((col("user_id") % 3).alias("company")).agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("since")))
query("agg_12_brier_blocks", f"SELECT l_linestatus AS status, l_linenumber::BIGINT AS line, count(*)::BIGINT AS n, {R(f'avg(pow({PP} - {Y}, 2))')} AS brier FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_linenumber), ())")(
    lambda t: t.lineitem.select(col("l_linestatus").alias("status"), big(col("l_linenumber")).alias("line"), F.pow(pp() - y(), lit(2.0)).alias("e")).groupingSets([["status"], ["line"], []], "status", "line").agg(F.count("*").alias("n"), M.r6(F.avg("e")).alias("brier"))
)
query("agg_13_brier", f"SELECT count(*)::BIGINT AS n, {R(f'avg({Y})')} AS base, {R(f'avg(pow({PP} - {Y}, 2))')} AS brier FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n"), M.r6(F.avg(y())).alias("base"), M.r6(F.avg(F.pow(pp() - y(), lit(2.0)))).alias("brier")))
query("agg_14_scores", f"SELECT {R(f'-avg({Y} * ln(least(greatest({PP}, 1e-6), 1 - 1e-6)) + (1 - {Y}) * ln(1 - least(greatest({PP}, 1e-6), 1 - 1e-6)))')} AS log_loss, {R(f'avg({Y})')} AS base FROM lineitem")(lambda t: t.lineitem.select(y().alias("y"), M.clip(pp(), 1e-6, 1 - 1e-6).alias("p")).agg(M.r6(-F.avg(col("y") * F.log("p") + (1 - col("y")) * F.log(1 - col("p")))).alias("log_loss"), M.r6(F.avg("y")).alias("base")))
query("agg_15_skill", f"SELECT l_linestatus, {R(f'1 - avg(pow({PP} - {Y}, 2)) / avg(pow(0.3 - {Y}, 2))')} AS skill FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_linestatus").agg(M.r6(1 - F.avg(F.pow(pp() - y(), lit(2.0))) / F.avg(F.pow(0.3 - y(), lit(2.0)))).alias("skill")))
query("agg_16_reliability", f"SELECT least(floor({PP} * 10 + 1e-9), 9)::BIGINT AS bin, count(*)::BIGINT AS n, {R(f'avg({PP})')} AS p, {R(f'avg({Y})')} AS obs FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(big(F.least(F.floor(pp() * 10 + 1e-9), lit(9))).alias("bin")).agg(F.count("*").alias("n"), M.r6(F.avg(pp())).alias("p"), M.r6(F.avg(y())).alias("obs")))
query("agg_17_rule_rates", f"SELECT {R(f'avg(CASE WHEN l_quantity >= 10 THEN {Y} END)')} AS wet, {R(f'avg(CASE WHEN l_quantity < 10 THEN {Y} END)')} AS dry FROM lineitem")(lambda t: t.lineitem.agg(M.r6(F.avg(F.when(col("l_quantity") >= 10, y()))).alias("wet"), M.r6(F.avg(F.when(col("l_quantity") < 10, y()))).alias("dry")))
query("agg_18_site_rate", f"SELECT s_suppkey, {R(f'coalesce(r, (SELECT avg({Y}) FROM lineitem WHERE l_tax > 0.06))')} AS rate FROM supplier LEFT JOIN (SELECT l_suppkey, avg({Y}) AS r FROM lineitem WHERE l_tax > 0.06 AND l_suppkey % 3 > 0 GROUP BY 1) ON l_suppkey = s_suppkey")(
    lambda t: t.supplier.select("s_suppkey").join(t.lineitem.filter("l_tax > 0.06 AND l_suppkey % 3 > 0").groupBy(col("l_suppkey").alias("s_suppkey")).agg(F.avg(y()).alias("r")), "s_suppkey", "left").crossJoin(F.broadcast(t.lineitem.filter("l_tax > 0.06").agg(F.avg(y()).alias("g")))).select("s_suppkey", M.r6(F.coalesce("r", "g")).alias("rate"))
)
query("agg_19_contingency", f"SELECT count_if({PP} >= 0.5 AND {Y} = 1)::BIGINT AS hit, count_if({PP} < 0.5 AND {Y} = 1)::BIGINT AS miss, count_if({PP} >= 0.5 AND {Y} = 0)::BIGINT AS false_alarm, count_if({PP} < 0.5 AND {Y} = 0)::BIGINT AS quiet FROM lineitem")(lambda t: t.lineitem.agg(F.count_if((pp() >= 0.5) & (y() == 1)).alias("hit"), F.count_if((pp() < 0.5) & (y() == 1)).alias("miss"), F.count_if((pp() >= 0.5) & (y() == 0)).alias("false_alarm"), F.count_if((pp() < 0.5) & (y() == 0)).alias("quiet")))
query("agg_20_paired_scores", f"SELECT {R(f'avg(pow({PP} - {Y}, 2))')} AS a, {R(f'avg(pow(l_tax * 10 - {Y}, 2))')} AS b, {R(f'avg(pow(0.33 - {Y}, 2))')} AS base FROM lineitem")(lambda t: t.lineitem.agg(M.r6(F.avg(F.pow(pp() - y(), lit(2.0)))).alias("a"), M.r6(F.avg(F.pow(col("l_tax") * 10 - y(), lit(2.0)))).alias("b"), M.r6(F.avg(F.pow(0.33 - y(), lit(2.0)))).alias("base")))
query("agg_21_distinct_any", "SELECT user_id, count(DISTINCT event_type)::BIGINT AS kinds, bool_or(event_type = 'purchase') AS any_purchase FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.bool_or(col("event_type") == "purchase").alias("any_purchase")))
query("agg_22_value_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")(lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "event_type"))
query("agg_23_season_tally", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, count_if(value >= 50)::BIGINT AS over FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count_if(col("value") >= 50).alias("over")))
query("agg_24_reasons", "SELECT CASE WHEN l_returnflag = 'N' THEN 'not_returned' WHEN l_tax > 0.05 THEN 'high_tax' ELSE 'scored' END AS reason, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(F.when(col("l_returnflag") == "N", "not_returned").when(col("l_tax") > 0.05, "high_tax").otherwise("scored").alias("reason")).agg(F.count("*").alias("n")))
query("agg_25_unstamped_days", "SELECT user_id, ts::DATE AS day FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE event_type = 'purchase') GROUP BY 1, 2 HAVING NOT bool_or(event_type = 'view')")(lambda t: t.events.crossJoin(F.broadcast(t.events.filter("event_type = 'purchase'").agg(F.min("ts").alias("first")))).filter("ts >= first").groupBy("user_id", day("ts").alias("day")).agg(F.bool_or(col("event_type") == "view").alias("ok")).filter("NOT ok").drop("ok"))
query("agg_26_pooled_ratio", f"SELECT CASE WHEN l_quantity <= 10 THEN '(0,10]' WHEN l_quantity <= 30 THEN '(10,30]' ELSE '(30,' END AS bucket, {R('sum(l_extendedprice) / sum(l_quantity)')} AS pooled, {R('median(l_extendedprice / l_quantity)')} AS mid FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(F.when(col("l_quantity") <= 10, "(0,10]").when(col("l_quantity") <= 30, "(10,30]").otherwise("(30,").alias("bucket")).agg(M.r6(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("pooled"), M.r6(F.median(col("l_extendedprice") / col("l_quantity"))).alias("mid")))
query("agg_27_errors", f"SELECT l_linenumber::BIGINT AS lead, {R('avg(abs(l_tax - l_discount))')} AS mae, {R('avg(l_tax - l_discount)')} AS bias, {R('corr(l_tax, l_discount)')} AS r FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(big(col("l_linenumber")).alias("lead")).agg(M.r6(F.avg(F.abs(col("l_tax") - col("l_discount")))).alias("mae"), M.r6(F.avg(col("l_tax") - col("l_discount"))).alias("bias"), M.r6(F.corr("l_tax", "l_discount")).alias("r")))
@query("agg_28_between_sites", f"SELECT {R('corr(ra, rb)')} AS rho FROM (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM (SELECT l_suppkey, avg(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1))")
def _between_sites(t):
    m = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"))
    return T.global_rank(T.global_rank(m, "a", "ra"), "b", "rb").agg(M.r6(F.corr("ra", "rb")).alias("rho"))


query("agg_29_summaries", "SELECT min(o_orderdate)::DATE AS first_day, count(DISTINCT o_custkey)::BIGINT AS sites FROM orders")(lambda t: t.orders.agg(day(F.min("o_orderdate")).alias("first_day"), F.countDistinct("o_custkey").alias("sites")))
query("agg_30_last_two_polls", "SELECT company, max(CASE WHEN k = 1 THEN n END)::BIGINT AS last_n, max(CASE WHEN k = 2 THEN n END)::BIGINT AS previous_n FROM (SELECT (user_id % 3)::BIGINT AS company, dense_rank() OVER (ORDER BY ts::DATE DESC) AS k, count(*) AS n FROM events GROUP BY user_id % 3, ts::DATE) WHERE k <= 2 GROUP BY 1")(
    lambda t: (g := t.events.groupBy((col("user_id") % 3).alias("company"), day("ts").alias("day")).agg(F.count("*").alias("n"))).join(F.broadcast(g.select("day").distinct().orderBy(col("day").desc()).limit(2).select("day", F.dense_rank().over(Window.orderBy(col("day").desc())).alias("k"))), "day").groupBy("company").agg(F.max(F.when(col("k") == 1, col("n"))).alias("last_n"), F.max(F.when(col("k") == 2, col("n"))).alias("previous_n"))
)
query("agg_31_health", "SELECT count(*)::BIGINT AS n, count_if(c_acctbal > 0)::BIGINT AS ok, count_if(c_acctbal > 0) >= 0.8 * count(*) AS healthy FROM customer")(lambda t: t.customer.agg(F.count("*").alias("n"), F.count_if(col("c_acctbal") > 0).alias("ok"), (F.count_if(col("c_acctbal") > 0) >= 0.8 * F.count("*")).alias("healthy")))
query("agg_32_best_day", "SELECT day, n FROM (SELECT ts::DATE AS day, count_if(value < 50)::BIGINT AS n FROM events GROUP BY 1) ORDER BY n DESC, day LIMIT 1")(lambda t: t.events.groupBy(day("ts").alias("day")).agg(F.count_if(col("value") < 50).alias("n")).orderBy(col("n").desc(), "day").limit(1))
query("agg_33_review_score", "SELECT conv_id, count(*)::BIGINT AS n, CASE WHEN count(*) >= 3 THEN (100 * count_if(role = 'user') // count(*))::BIGINT END AS pct FROM conversations GROUP BY 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.floor(100 * F.count_if(col("role") == "user") / F.count("*"))).cast("bigint").alias("pct")))
query("agg_34_group_concat", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, max(turn) AS last_turn FROM conversations GROUP BY 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ",").alias("roles"), F.max("turn").alias("last_turn")))
query("agg_35_latest_issue", f"SELECT cell, max(day) AS day FROM {DAILY} GROUP BY 1")(lambda t: daily(t).groupBy("cell").agg(F.max("day").alias("day")))
query("agg_36_running_min", f"SELECT line, {R('min(s) OVER (ORDER BY line) / first_value(s) OVER (ORDER BY line)')} AS skill FROM (SELECT l_linenumber::BIGINT AS line, avg(l_quantity) AS s FROM lineitem GROUP BY 1)")(lambda t: t.lineitem.groupBy(big(col("l_linenumber")).alias("line")).agg(F.avg("l_quantity").alias("s")).select("line", M.r6(F.min("s").over(Window.orderBy("line")) / F.first("s").over(Window.orderBy("line"))).alias("skill")))

# --- sorts and sets ----------------------------------------------------------------------------------------------

query("srt_2_one_row_per_site", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1")(lambda t: T.latest_per(t.events.select("user_id", "event_id", F.when(col("event_type") != "error", col("ts")).alias("u")), ["user_id"], [col("u").desc_nulls_last(), col("event_id").desc()]).select("user_id", "event_id"))
query("srt_3_one_row_three_keys", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")(lambda t: T.latest_per(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), ["o_custkey"], [col("o_orderdate").desc(), col("o_orderpriority"), col("o_orderkey").desc()]).select("o_custkey", "o_orderkey"))
query("srt_4_duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS line, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda t: t.lineitem.groupBy("l_orderkey", big(col("l_linenumber")).alias("line")).agg(F.count("*").alias("n")).filter("n > 1"))
query("srt_5_history_dedupe", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CASE WHEN value > 50 THEN value END, CASE WHEN value <= 50 THEN ts::DATE END ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")(lambda t: T.latest_per(t.events.select("event_id", "user_id", "event_type", "ts", F.when(col("value") > 50, col("value")).alias("v"), F.when(col("value") <= 50, day("ts")).alias("dd")), ["user_id", "event_type", "v", "dd"], [col("ts").desc(), col("event_id").desc()]).select("event_id"))
query("srt_6_source_preference", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1")(lambda t: T.latest_per(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [F.when(col("o_orderstatus") == "F", 0).when(col("o_orderstatus") == "O", 1).otherwise(2), col("o_orderkey")]).select("o_custkey", "o_orderkey"))
query("srt_7_by_weight", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")(lambda t: t.supplier.select("s_suppkey", "s_acctbal").orderBy(col("s_acctbal").desc(), "s_suppkey"))
query("srt_8_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS line, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY greatest(l_tax, l_discount) DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5")(
    lambda t: t.lineitem.select("l_suppkey", "l_orderkey", big(col("l_linenumber")).alias("line"), "l_extendedprice", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.greatest("l_tax", "l_discount").desc(), col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")).alias("rn")).filter("rn <= 5").drop("rn")
)
query("srt_9_rank_one", "SELECT c_nationkey::BIGINT AS nation, arg_min(c_custkey, (c_mktsegment <> 'BUILDING', abs(c_acctbal - 5000), c_custkey)) AS station FROM customer GROUP BY 1")(lambda t: t.customer.groupBy(big(col("c_nationkey")).alias("nation")).agg(F.min_by("c_custkey", F.struct((col("c_mktsegment") != "BUILDING"), F.abs(col("c_acctbal") - 5000), col("c_custkey"))).alias("station")))
query("srt_10_within_sorted", "SELECT c_custkey, abs(c_acctbal - 5000) AS d FROM customer WHERE abs(c_acctbal - 5000) < 500 ORDER BY d, c_custkey")(lambda t: t.customer.select("c_custkey", F.abs(col("c_acctbal") - 5000).alias("d")).filter("d < 500").orderBy("d", "c_custkey"))
query("srt_12_newest_first", "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn DESC) AS turns FROM conversations GROUP BY 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn"), asc=False), lambda v: v.cast("string")), ",").alias("turns")))
query("srt_13_recent", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")(lambda t: T.latest_per(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderdate"], [col("o_orderkey")]).orderBy(col("o_orderdate").desc(), "o_orderkey").limit(30).select("o_custkey", "o_orderkey"))
query("srt_14_by_rho", f"SELECT l_suppkey, {R('corr(l_quantity, l_extendedprice)')} AS rho FROM lineitem GROUP BY 1 ORDER BY rho DESC, 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(M.r6(F.corr("l_quantity", "l_extendedprice")).alias("rho")).orderBy(col("rho").desc(), "l_suppkey"))
query("srt_15_by_severity", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <= '2-HIGH' ORDER BY o_orderpriority, o_orderkey")(lambda t: t.orders.filter("o_orderpriority <= '2-HIGH'").select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey"))
query("srt_16_oldest_budget", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")(lambda t: t.orders.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey"))
query("srt_17_first_placed", "SELECT c_nationkey::BIGINT AS nation, min(c_custkey) AS site FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1")(lambda t: t.customer.filter("c_acctbal > 0").groupBy(big(col("c_nationkey")).alias("nation")).agg(F.min("c_custkey").alias("site")).orderBy("nation"))
query("set_1_union_all", "SELECT c_custkey AS k, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")(lambda t: t.customer.select(col("c_custkey").alias("k"), lit("customer").alias("source")).unionByName(t.supplier.select(col("s_suppkey").alias("k"), lit("supplier").alias("source"))))
query("set_2_union_distinct", "SELECT o_custkey AS site, o_orderdate::DATE AS day FROM orders UNION SELECT o_custkey, o_orderdate::DATE + 1 FROM orders")(lambda t: t.orders.select(col("o_custkey").alias("site"), F.explode(F.array(day("o_orderdate"), F.date_add("o_orderdate", 1))).alias("day")).distinct())
query("set_3_difference", "SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")(lambda t: t.customer.filter("c_acctbal > 9900").select(big(col("c_nationkey")).alias("k")).distinct().join(t.supplier.filter("s_acctbal > 9000").select(big(col("s_nationkey")).alias("k")), "k", "left_anti"))
query("set_4_word_intersection", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['hot', 'gear', 'red']))::BIGINT AS n FROM part")(lambda t: t.part.select("p_partkey", big(F.size(F.array_intersect(F.split("p_name", " "), F.array(lit("hot"), lit("gear"), lit("red"))))).alias("n")))
query("set_5_change_set", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'moved' END AS change FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")(
    lambda t: t.customer.filter("c_custkey % 7 <> 0").select(col("c_custkey").alias("k"), col("c_nationkey").alias("v"), lit(1).alias("ina")).join(t.customer.filter("c_custkey % 5 <> 0").select(col("c_custkey").alias("k"), F.when(col("c_custkey") % 11 != 0, col("c_nationkey")).alias("w"), lit(1).alias("inb")), "k", "full").filter("ina IS NULL OR inb IS NULL OR NOT (v <=> w)").select("k", F.when(col("ina").isNull(), "added").when(col("inb").isNull(), "removed").otherwise("moved").alias("change"))
)
query("set_6_subset", "SELECT NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS is_subset")(lambda t: t.customer.select(col("c_nationkey").alias("n_nationkey")).join(t.nation, "n_nationkey", "left_anti").agg((F.count("*") == 0).alias("is_subset")))
query("set_7_distinct_cells", "SELECT DISTINCT (s_suppkey % 90 // 10)::BIGINT AS cell FROM supplier ORDER BY 1")(lambda t: t.supplier.select(F.floor(col("s_suppkey") % 90 / 10).alias("cell")).distinct().orderBy("cell"))
query("set_8_partition", "SELECT count(*)::BIGINT AS total, count_if(l_tax > 0.06)::BIGINT AS missed, count_if(l_tax <= 0.06 AND l_returnflag = 'N')::BIGINT AS uncovered, count_if(l_tax <= 0.06 AND l_returnflag <> 'N')::BIGINT AS scored FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("total"), F.count_if(col("l_tax") > 0.06).alias("missed"), F.count_if((col("l_tax") <= 0.06) & (col("l_returnflag") == "N")).alias("uncovered"), F.count_if((col("l_tax") <= 0.06) & (col("l_returnflag") != "N")).alias("scored")))
query("set_9_union_cells", "SELECT DISTINCT k FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")(lambda t: t.customer.select(big(col("c_nationkey")).alias("k")).unionByName(t.supplier.select(big(col("s_nationkey")).alias("k"))).distinct())
