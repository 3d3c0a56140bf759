"""Scans and sinks, cleaning, networks, places, streams, models, evaluation, rules and the entry points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvia.functions import geo
from fluvia.functions import maths as M
from fluvia.operators import graph as G
from fluvia.operators import spatial as S
from fluvia.operators import temporal as T
from fluvia.plans.base import big, col, lit, project, query
from fluvia.plans.relational import DAILY, PP, R, Y, daily, day, pp, y

# --- scans and sinks ---------------------------------------------------------------------------------------------

query("src_3_best_read", "SELECT arg_max(read, (n, -read))::BIGINT AS read, max(n)::BIGINT AS n_keys FROM (SELECT l_linenumber AS read, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)")(lambda t: t.lineitem.groupBy("l_linenumber").agg(F.countDistinct("l_orderkey").alias("n")).agg(F.max_by(big(col("l_linenumber")), F.struct("n", -col("l_linenumber"))).alias("read"), F.max("n").alias("n_keys")))
query("src_4_count", "SELECT count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 0")(lambda t: t.customer.filter("c_acctbal > 0").agg(F.count("*").alias("n")))
query("src_5_statistics", f"SELECT c_nationkey::BIGINT AS g, count(*)::BIGINT AS n, {R('avg(c_acctbal)')} AS mean FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")(lambda t: t.customer.filter("c_mktsegment = 'BUILDING'").groupBy(big(col("c_nationkey")).alias("g")).agg(F.count("*").alias("n"), M.r6(F.avg("c_acctbal")).alias("mean")))
query("src_6_distinct", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0")(lambda t: t.customer.filter("c_acctbal > 0").select("c_mktsegment").distinct())
query("src_8_union_feeds", "SELECT c_custkey AS id, 'customer' AS company, c_acctbal AS lat FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier WHERE s_acctbal > 0")(
    lambda t: t.customer.withColumnsRenamed({"c_custkey": "id", "c_acctbal": "lat"}).withColumn("company", lit("customer")).unionByName(t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "lat"}).withColumn("company", lit("supplier")), allowMissingColumns=True).filter("lat > 0").select("id", "company", "lat")
)
query("src_9_event_history", "SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'error' ORDER BY user_id, ts, event_id")(lambda t: t.events.filter("event_type = 'error'").orderBy("user_id", "ts", "event_id").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("d")))
query("src_10_coerce", "SELECT p_partkey, try_cast(string_split(p_brand, '#')[2] AS DOUBLE) AS brand FROM part")(lambda t: t.part.select("p_partkey", F.get(F.split("p_brand", "#"), lit(1)).try_cast("double").alias("brand")))
query("src_13_unpivot_leads", "SELECT l_orderkey, l_linenumber::BIGINT AS line, lead, v FROM (SELECT l_orderkey, l_linenumber, unnest(['tax', 'discount']) AS lead, unnest([l_tax, l_discount]) AS v FROM lineitem)")(lambda t: t.lineitem.select("l_orderkey", big(col("l_linenumber")).alias("line"), col("l_tax").alias("tax"), col("l_discount").alias("discount")).unpivot(["l_orderkey", "line"], ["tax", "discount"], "lead", "v"))
query("src_14_column_arrays", "SELECT user_id, unnest(k)::BIGINT AS k, unnest(v) AS v FROM (SELECT user_id, list(event_id ORDER BY event_id) AS k, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)")(lambda t: t.events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("r")).select("user_id", F.explode(F.arrays_zip(col("r.event_id").alias("k"), col("r.value").alias("v"))).alias("z")).select("user_id", "z.k", "z.v"))
query("src_20_oriented_links", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey // 2 ELSE p_partkey END AS a, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey // 2 END AS b FROM part")(lambda t: t.part.select("p_partkey", F.floor(col("p_partkey") / 2).alias("h"), (col("p_size") % 2 == 0).alias("rev")).select("p_partkey", F.when(col("rev"), col("h")).otherwise(col("p_partkey")).alias("a"), F.when(col("rev"), col("p_partkey")).otherwise(col("h")).alias("b")))
query("src_21_spot_lists", "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM (SELECT c_custkey AS id, 'a' AS source, 1 AS o FROM customer UNION ALL SELECT s_suppkey, 'b', 2 FROM supplier)) WHERE rn = 1")(lambda t: T.latest_per(t.customer.select(col("c_custkey").alias("id"), lit("a").alias("source"), lit(1).alias("o")).unionByName(t.supplier.select(col("s_suppkey").alias("id"), lit("b").alias("source"), lit(2).alias("o"))), ["id"], [col("o")]).select("id", "source"))
query("src_25_log_read", "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms FROM events")(lambda t: t.events.select("event_id", F.unix_millis(col("ts").cast("timestamp")).alias("ms")))
query("src_29_mapped_observations", "SELECT DISTINCT user_id, ts::DATE AS day FROM events JOIN supplier ON s_suppkey = user_id WHERE month(ts) = 1")(lambda t: t.events.filter(F.month("ts") == 1).join(t.supplier.select(col("s_suppkey").alias("user_id")), "user_id").select("user_id", day("ts").alias("day")).dropDuplicates())
query("src_30_source_status", "SELECT event_type AS source, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS points FROM events GROUP BY 1")(lambda t: t.events.groupBy(col("event_type").alias("source")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("points")))
query("src_31_needed_cells", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")(lambda t: t.events.select("event_id", "user_id").join(t.supplier.filter("s_acctbal > 5000").select(col("s_suppkey").alias("user_id")), "user_id", "left_semi").select("event_id"))
query("src_32_dimension", "SELECT DISTINCT s_nationkey::BIGINT AS company FROM supplier")(lambda t: t.supplier.select(big(col("s_nationkey")).alias("company")).dropDuplicates())
@query("snk_1_write_count", "SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def _write_count(t):
    """The table written as Parquet, and what a reader finds there."""
    return G._step(t.orders).agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("bigint").alias("keys"))


_ASKED = {"large": "p_size > 40", "brass": "p_type LIKE '%BRASS'", "dear": "p_retailprice > 1500", "first": "p_brand = 'Brand#11'"}


@query(
    "src_22_merged_elements",
    "SELECT p_partkey AS id, string_agg(q, ',' ORDER BY q) AS matched FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{q}' AS q FROM part WHERE {w}" for q, w in _ASKED.items()) + ") GROUP BY 1",
)
def _merged_elements(t):
    """Elements of several queries, one row for each, with the queries that found it. One scan answers all of them."""
    found = F.array_compact(F.array(*[F.when(F.expr(w), q) for q, w in sorted(_ASKED.items())]))
    return t.part.select(col("p_partkey").alias("id"), found.alias("found")).filter("size(found) > 0").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found")).select("id", F.array_join("found", ",").alias("matched"))


query("snk_2_forecast_rows", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_shipdate::DATE AS target_day, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) >= 0")(lambda t: t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).select("l_orderkey", big(col("l_linenumber")).alias("line"), day("l_shipdate").alias("target_day"), big(F.datediff("l_shipdate", "o_orderdate")).alias("lead")).filter("lead >= 0"))
query("snk_3_scored_csv", "SELECT strftime(o_orderdate, '%Y-%m-%d') || ',' || o_orderkey || ',' || printf('%.4f', o_totalprice / 1000000 + 1e-9) AS line FROM orders ORDER BY o_orderdate, o_orderkey")(lambda t: t.orders.orderBy("o_orderdate", "o_orderkey").select(F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), col("o_orderkey").cast("string"), F.format_string("%.4f", col("o_totalprice") / 1000000 + 1e-9)).alias("line")))
query("snk_5_features", "SELECT '{\"type\":\"Feature\",\"id\":' || s_suppkey || '}' AS feature FROM supplier WHERE s_suppkey % 90 BETWEEN 10 AND 40")(lambda t: t.supplier.filter("s_suppkey % 90 BETWEEN 10 AND 40").select(F.to_json(F.struct(lit("Feature").alias("type"), col("s_suppkey").alias("id"))).alias("feature")))
query("snk_6_delta_records", "SELECT l_suppkey, string_agg(d::VARCHAR, ',' ORDER BY k) AS code FROM (SELECT l_suppkey, k, k - coalesce(lag(k) OVER (PARTITION BY l_suppkey ORDER BY k), 0) AS d FROM (SELECT DISTINCT l_suppkey, l_orderkey AS k FROM lineitem)) GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_orderkey")).alias("x")).select("l_suppkey", F.array_join(F.transform("x", lambda v, i: (v - F.coalesce(F.get(col("x"), i - 1), lit(0))).cast("string")), ",").alias("code")))
query("snk_8_tiles", "SELECT (s_suppkey % 90 // 4)::BIGINT AS tile, count(*)::BIGINT AS n FROM supplier GROUP BY 1")(lambda t: t.supplier.groupBy(F.floor(col("s_suppkey") % 90 / 4).alias("tile")).agg(F.count("*").alias("n")))
query("snk_9_daily_document", f"SELECT cell, string_agg(coalesce(round(least(rain / 1000, 1) * 1000)::BIGINT::VARCHAR, 'null'), ',' ORDER BY day) AS p FROM {DAILY} GROUP BY 1")(lambda t: daily(t).groupBy("cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(col("day").isNull().alias("none"), "day", F.coalesce(F.round(F.least(col("rain") / 1000, lit(1.0)) * 1000).cast("bigint").cast("string"), lit("null")).alias("p")))), lambda s: s["p"]), ",").alias("p")))
query("snk_14_alert_document", "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 8000 THEN 3 WHEN s_acctbal > 4000 THEN 2 ELSE 1 END::BIGINT AS rank FROM supplier")(lambda t: t.supplier.select(col("s_suppkey").alias("id"), big(F.when(col("s_acctbal") > 8000, 3).when(col("s_acctbal") > 4000, 2).otherwise(1)).alias("rank")))
query("snk_15_csv_row", "SELECT c_custkey || ',' || c_name || ',' || c_mktsegment AS row FROM customer")(lambda t: t.customer.select(F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("row")))
query("snk_17_undescribed", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000)")(lambda t: t.nation.select(big(col("n_nationkey")).alias("k")).join(t.supplier.filter("s_acctbal > 6000").select(big(col("s_nationkey")).alias("k")), "k", "left_anti"))

# --- projections and cleaning ------------------------------------------------------------------------------------

project("prj_1_times", "events", "event_id", {"utc": lambda: F.date_format(F.when(col("event_id") % 2 == 0, F.timestamp_millis(F.unix_millis(col("ts").cast("timestamp")))).otherwise(F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))), "yyyy-MM-dd HH:mm:ss")}, {"utc": "strftime(ts, '%Y-%m-%d %H:%M:%S')"})
query("prj_2_normalise_events", f"SELECT l_orderkey, l_linenumber::BIGINT AS line, {R('date_diff(\'day\', o_orderdate::DATE, l_shipdate::DATE) * 24.0')} AS duration_h FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) * 24 BETWEEN 0 AND 1439")(lambda t: t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).select("l_orderkey", big(col("l_linenumber")).alias("line"), M.r6(F.datediff("l_shipdate", "o_orderdate") * 24.0).alias("duration_h")).filter("duration_h >= 0 AND duration_h < 1440"))
query("prj_3_box", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 90 BETWEEN 20 AND 60 AND s_acctbal IS NOT NULL")(lambda t: t.supplier.filter((col("s_suppkey") % 90).between(20, 60) & col("s_acctbal").isNotNull()).select("s_suppkey"))
project("prj_4_coalesce", "customer", "c_custkey", {"v": lambda: F.coalesce(F.when(col("c_acctbal") > 5000, col("c_acctbal")), F.when(col("c_nationkey") > 10, col("c_nationkey").cast("double")), lit(0.0))}, {"v": "coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, CASE WHEN c_nationkey > 10 THEN c_nationkey::DOUBLE END, 0.0)"})
project("prj_5_marine", "part", "p_partkey", {"marine": lambda: col("p_name").rlike(r"(?i)\b(sea|hot|bay|channel)\b")}, {"marine": r"regexp_matches(p_name, '(?i)\b(sea|hot|bay|channel)\b')"})
project("prj_6_drop_rules", "part", "p_partkey", {"dropped_by": lambda: F.when(col("p_size") > 40, "large").when(col("p_type").like("%BRASS"), "brass").when(col("p_retailprice") < 905, "cheap")}, {"dropped_by": "CASE WHEN p_size > 40 THEN 'large' WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_retailprice < 905 THEN 'cheap' END"})
query("prj_7_quality_days", f"SELECT cell, day FROM {DAILY} WHERE rain IS NOT NULL AND n_hours >= 3")(lambda t: daily(t).filter("rain IS NOT NULL AND n_hours >= 3").select("cell", "day"))
project("prj_8_json_safe", "lineitem", "l_orderkey, l_linenumber, l_quantity", {"v": lambda: M.r6((lambda c: F.when(F.isnan(c), None).otherwise(c))(F.when(col("l_tax") == 0, lit(float("nan"))).otherwise(col("l_tax"))))}, {"v": R("CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END")})
project("prj_9_detection_limit", "part", "p_partkey", {"value": lambda: F.regexp_extract(F.concat(F.when(col("p_size") < 10, "<").otherwise(""), col("p_size").cast("string")), "([0-9.]+)", 1).try_cast("double"), "qual": lambda: F.regexp_extract(F.concat(F.when(col("p_size") < 10, "<").otherwise(""), col("p_size").cast("string")), "^([<>]?)", 1)}, {"value": "p_size::DOUBLE", "qual": "CASE WHEN p_size < 10 THEN '<' ELSE '' END"})
project("prj_10_last_segment", "pages", "page_id", {"seg": lambda: F.element_at(F.split("url", "/"), -1)}, {"seg": "string_split(url, '/')[-1]"})
project("prj_11_url_rows", "pages", "page_id", {"lang": lambda: F.get(F.split("url", "/"), lit(3)), "num": lambda: F.substring_index("url", "/", -1).try_cast("bigint")}, {"lang": "string_split(url, '/')[4]", "num": "try_cast(string_split(url, '/')[-1] AS BIGINT)"})
project("prj_12_local_to_utc", "orders", "o_orderkey", {"utc": lambda: F.date_format(F.to_utc_timestamp(col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS"), "Europe/London"), "yyyy-MM-dd HH:mm")}, {"utc": "strftime((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')"})
query("prj_13_plausible", "SELECT event_id FROM events WHERE value BETWEEN 1 AND 35 AND ts >= TIMESTAMP '2024-01-10'")(lambda t: t.events.filter("value BETWEEN 1 AND 35 AND ts >= '2024-01-10'").select("event_id"))
project("prj_14_stale_reading", "events", "event_id", {"level": lambda: F.when(~(col("ts") < "2024-01-15"), col("value")), "last_level": lambda: F.when(col("ts") < "2024-01-15", col("value"))}, {"level": "CASE WHEN NOT ts < TIMESTAMP '2024-01-15' THEN value END", "last_level": "CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END"})
query("prj_15_shift_year", f"SELECT o_custkey, (year(o_orderdate) + 1)::BIGINT AS year, count(*)::BIGINT AS n, {R('sum(o_totalprice)')} AS v FROM orders GROUP BY 1, 2")(lambda t: t.orders.groupBy("o_custkey", big(F.year("o_orderdate") + 1).alias("year")).agg(F.count("*").alias("n"), M.r6(F.sum("o_totalprice")).alias("v")))
project("prj_16_input_checks", "conversations", "conv_id, turn", {"ok": lambda: (F.length("text") >= 20) & ~col("text").rlike("https?://")}, {"ok": "length(text) >= 20 AND NOT regexp_matches(text, 'https?://')"})
project("prj_17_in_season", "orders", "o_orderkey", {"s": lambda: F.month("o_orderdate").between(5, 9)}, {"s": "month(o_orderdate) BETWEEN 5 AND 9"})
project("prj_18_rounding", "lineitem", "l_orderkey, l_linenumber, l_extendedprice", {"v": lambda: F.round(col("l_extendedprice") / 7 + 1e-9, 3)}, {"v": "round(l_extendedprice / 7 + 1e-9, 3)"})
query("prj_20_id_map", "SELECT k, max_by(v, o) AS v FROM (SELECT c_custkey AS k, c_name AS v, 1 AS o FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier) GROUP BY 1")(lambda t: t.customer.select(col("c_custkey").alias("k"), col("c_name").alias("v"), lit(1).alias("o")).unionByName(t.supplier.select(col("s_suppkey").alias("k"), col("s_name").alias("v"), lit(2).alias("o"))).groupBy("k").agg(F.max_by("v", "o").alias("v")))
project("prj_21_stale", "events", "event_id", {"stale": lambda: F.coalesce(F.when(col("event_type") != "error", col("ts")) < F.to_timestamp(lit("2024-01-20")), lit(True))}, {"stale": "coalesce(CASE WHEN event_type <> 'error' THEN ts END < TIMESTAMP '2024-01-20', true)"})
#: Two numbers in either order, one in seven out of the box.
_A22, _B22 = "50 + s_suppkey % 80 / 10.0 + CASE WHEN s_suppkey % 7 = 0 THEN 40 ELSE 0 END", "-5 + s_suppkey % 60 / 10.0"
_SWAP22 = "s_suppkey % 2 = 0"


@query(
    "prj_22_swapped_pair",
    f"""WITH p AS (SELECT s_suppkey, ({_A22})::DOUBLE AS lat0, ({_B22})::DOUBLE AS lon0 FROM supplier),
q AS (SELECT s_suppkey, CASE WHEN {_SWAP22} THEN lon0 ELSE lat0 END AS a, CASE WHEN {_SWAP22} THEN lat0 ELSE lon0 END AS b FROM p),
r AS (SELECT *, a BETWEEN 49.8 AND 60.95 AND b BETWEEN -8.7 AND 1.8 AS straight, b BETWEEN 49.8 AND 60.95 AND a BETWEEN -8.7 AND 1.8 AS turned FROM q)
SELECT s_suppkey, round(CASE WHEN straight THEN a WHEN turned THEN b END, 6) AS lat, round(CASE WHEN straight THEN b WHEN turned THEN a END, 6) AS lon, (NOT straight AND turned) AS turned FROM r""",
)
def _swapped_pairs(t):
    x = t.supplier.select("s_suppkey", F.expr(_A22).cast("double").alias("lat0"), F.expr(_B22).cast("double").alias("lon0"), F.expr(_SWAP22).alias("s"))
    a, b = F.when(col("s"), col("lon0")).otherwise(col("lat0")), F.when(col("s"), col("lat0")).otherwise(col("lon0"))
    lat, lon, turned = geo.lat_lon_in_box(a, b)
    return x.select("s_suppkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), turned.alias("turned"))



# --- networks: edges of the part tree ----------------------------------------------------------------------------

EDGES = "(SELECT p_partkey AS src, p_partkey // 2 AS dst, p_size::DOUBLE AS length FROM part WHERE p_partkey > 1)"


def edges(t):
    return t.part.filter("p_partkey > 1").select(col("p_partkey").alias("src"), F.floor(col("p_partkey") / 2).alias("dst"), col("p_size").cast("double").alias("length"))


UP = f"""WITH RECURSIVE up AS (SELECT s_suppkey AS root, s_suppkey AS node, 0.0::DOUBLE AS dist FROM supplier
UNION ALL SELECT root, e.src, dist + e.length FROM up JOIN {EDGES} e ON e.dst = up.node WHERE dist + e.length <= 120)"""


def upstream(t, roots: str = "true"):
    return G.closure(edges(t), t.supplier.filter(roots).select(col("s_suppkey").alias("node")), 120.0)


query("grf_1_edges", f"SELECT src, dst, length FROM {EDGES}")(edges)
query("grf_2_heads_sinks", f"SELECT node, kind FROM (SELECT DISTINCT src AS node, 'head' AS kind FROM {EDGES} WHERE src NOT IN (SELECT dst FROM {EDGES}) UNION ALL SELECT DISTINCT dst, 'sink' FROM {EDGES} WHERE dst NOT IN (SELECT src FROM {EDGES}))")(lambda t: G.heads(edges(t)).withColumn("kind", lit("head")).unionByName(G.sinks(edges(t)).withColumn("kind", lit("sink"))))
query("grf_5_upstream", UP + " SELECT root, node, dist FROM up")(upstream)
query("grf_6_upstream_length", UP + f" SELECT root, {R('sum(e.length)')} AS total FROM up JOIN {EDGES} e ON e.src = up.node AND up.node <> root GROUP BY 1")(lambda t: upstream(t).filter("node <> root").join(edges(t).select(col("src").alias("node"), "length"), "node").groupBy("root").agg(M.r6(F.sum("length")).alias("total")))
query("grf_7_lookup_length", f"SELECT dst AS node, {R('sum(length)')} AS near FROM {EDGES} GROUP BY 1")(lambda t: edges(t).groupBy(col("dst").alias("node")).agg(M.r6(F.sum("length")).alias("near")))
query("grf_8_reach", f"""WITH RECURSIVE dn AS (SELECT s_suppkey + 1000 AS root, s_suppkey + 1000 AS node, 0.0::DOUBLE AS dist FROM supplier
UNION ALL SELECT root, e.dst, dist + e.length FROM dn JOIN {EDGES} e ON e.src = dn.node WHERE dist + e.length <= 90) SELECT root, node, dist FROM dn""")(lambda t: G.closure(G.reversed_edges(edges(t)), t.supplier.select((col("s_suppkey") + 1000).alias("node")), 90.0))
#: Links of this length or more are a lake's.
LAKE_LINK = 25


@query(
    "grf_9_components",
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} WHERE length >= {LAKE_LINK}), w AS (SELECT DISTINCT node, node AS top FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)
UNION ALL SELECT w.node, e.dst FROM w JOIN e ON e.src = w.top) SELECT node, min(top) AS label FROM w GROUP BY 1""",
)
def _lakes(t):
    """Lake links that share nodes, by the smallest node."""
    return G.min_label(edges(t).filter(col("length") >= LAKE_LINK).select("src", "dst"))


query("grf_12_named_downstream", f"WITH RECURSIVE w AS (SELECT p_partkey AS link, p_partkey AS pos, 0 AS step FROM part UNION ALL SELECT link, pos // 2, step + 1 FROM w WHERE step < 12 AND pos > 1 AND (pos % 5) <> 0) SELECT link, arg_max(pos, step) AS named FROM w GROUP BY 1")(lambda t: _named(t))


def _named(t):
    """Twelve steps to the first successor, a named link (every fifth) being its own: the step composed with itself, so four joins make twelve."""
    after = edges(t).groupBy(col("src").alias("link")).agg(F.min("dst").alias("next"))
    one = t.part.select(col("p_partkey").alias("link")).join(after, "link", "left").select("link", F.when(col("link") % 5 == 0, col("link")).otherwise(F.coalesce("next", "link")).alias("named"))
    then = lambda f, g: f.join(g.select(col("link").alias("_l"), col("named").alias("_n")), col("named") == col("_l")).select("link", col("_n").alias("named"))
    two = G._step(then(one, one))
    four = G._step(then(two, two))
    return then(then(four, four), four)


_WGT = R("pow(10, -dist / 0.5 / 3600 / 30) * least(1.0, 5000 / (dist + 5000))")
query("grf_14_source_weights", UP + f" SELECT root, s_suppkey, {_WGT} AS weight FROM up JOIN supplier ON s_suppkey = node")(lambda t: upstream(t).join(t.supplier.select("s_suppkey"), col("node") == col("s_suppkey")).select("root", "s_suppkey", M.r6(M.decay(col("dist") / 0.5 / 3600) * F.least(lit(1.0), lit(5000.0) / (col("dist") + 5000))).alias("weight")))
query("grf_15_open_in_position", UP + f" SELECT root, node, {R('dist + 0.25 * p_size')} AS base FROM up JOIN part ON p_partkey = root")(lambda t: upstream(t).join(t.part.select(col("p_partkey").alias("root"), "p_size"), "root").select("root", "node", M.r6(col("dist") + 0.25 * col("p_size")).alias("base")))
query("grf_16_affected", f"WITH RECURSIVE dn AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9500 UNION SELECT node // 2 FROM dn WHERE node > 1) SELECT DISTINCT node FROM dn WHERE node > 0")(lambda t: G.closure(G.reversed_edges(edges(t)), t.supplier.filter("s_acctbal > 9500").select(col("s_suppkey").alias("node")), 1e9).select("node").filter("node > 0").distinct())
query("grf_17_node_points", f"SELECT node, min(k) AS link FROM (SELECT src AS node, src AS k FROM {EDGES} UNION ALL SELECT dst, src FROM {EDGES}) GROUP BY 1")(lambda t: edges(t).select(F.explode(F.array("src", "dst")).alias("node"), col("src").alias("k")).groupBy("node").agg(F.min("k").alias("link")))

# --- places ------------------------------------------------------------------------------------------------------

PX, PY = "(c_custkey * 37 % 1000)::DOUBLE", "(c_custkey * 91 % 1000)::DOUBLE"
QX, QY = "(s_suppkey * 53 % 1000)::DOUBLE", "(s_suppkey * 29 % 1000)::DOUBLE"


def pins(t):
    return t.customer.select("c_custkey", (col("c_custkey") * 37 % 1000).cast("double").alias("px"), (col("c_custkey") * 91 % 1000).cast("double").alias("py"))


def stations(t):
    return t.supplier.select("s_suppkey", (col("s_suppkey") * 53 % 1000).cast("double").alias("qx"), (col("s_suppkey") * 29 % 1000).cast("double").alias("qy"))


DIST = f"sqrt(pow({PX} - {QX}, 2) + pow({PY} - {QY}, 2))"
query("jon_14_nearest", f"SELECT c_custkey, arg_min(s_suppkey, ({DIST}, s_suppkey)) AS s_suppkey, {R(f'min({DIST})')} AS dist FROM customer, supplier WHERE {DIST} <= 60 GROUP BY 1")(lambda t: S.nearest_join(pins(t), stations(t), "c_custkey", "s_suppkey", 60.0).withColumn("dist", M.r6(col("dist"))))
query("jon_15_within", f"SELECT c_custkey, s_suppkey FROM customer, supplier WHERE {DIST} <= 40")(lambda t: S.within_join(pins(t), stations(t), 40.0).select("c_custkey", "s_suppkey"))
query("jon_17_nearest_listed", f"SELECT c_custkey, arg_min(s_suppkey, ({DIST}, s_suppkey)) AS s_suppkey FROM customer, supplier WHERE {DIST} <= 300 GROUP BY 1")(lambda t: S.nearest_join(pins(t), stations(t), "c_custkey", "s_suppkey", 300.0).drop("dist"))
_RING = [(100.0, 100.0), (700.0, 200.0), (600.0, 800.0), (300.0, 500.0)]
_CROSS = " + ".join(f"((({ay} > {PY}) <> ({by} > {PY})) AND {PX} < {bx - ax} * ({PY} - {ay}) / {by - ay} + {ax})::INT" for (ax, ay), (bx, by) in zip(_RING, [*_RING[1:], _RING[0]], strict=True))
query("geo_7_in_ring", f"SELECT c_custkey FROM customer WHERE ({_CROSS}) % 2 = 1")(lambda t: pins(t).filter(S.in_ring(col("px"), col("py"), _RING)).select("c_custkey"))
#: A lake round each station: corners of a ring, as offsets. No point of the whole grid lies on its edges.
_LAKE = [(30.5, 0.0), (0.0, 20.5), (-25.5, 0.0), (0.0, -40.5)]
_EDGES16 = [(*p, *q) for p, q in zip(_LAKE, [*_LAKE[1:], _LAKE[0]], strict=True)]
_IN16 = " + ".join(f"((({QY} + {ay} > {PY}) <> ({QY} + {by} > {PY})) AND {PX} < {bx - ax} * ({PY} - ({QY} + {ay})) / {by - ay} + {QX} + {ax})::INT" for ax, ay, bx, by in _EDGES16)


def _edge16(ax: float, ay: float, bx: float, by: float) -> str:
    t = f"greatest(0.0, least(1.0, (({PX} - {QX} - {ax}) * {bx - ax} + ({PY} - {QY} - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2}))"
    return f"sqrt(pow({PX} - {QX} - {ax} - {t} * {bx - ax}, 2) + pow({PY} - {QY} - {ay} - {t} * {by - ay}, 2))"


_SHORE16 = f"least({', '.join(_edge16(*e) for e in _EDGES16)})"


@query("jon_16_ring_join", f"SELECT c_custkey, s_suppkey, ({_IN16}) % 2 = 1 AS inside, {R(_SHORE16)} AS to_shore FROM customer, supplier WHERE ({_IN16}) % 2 = 1 OR {_SHORE16} <= 8")
def _ring_join(t):
    corner = lambda x, y: F.struct((col("qx") + x).alias("x"), (col("qy") + y).alias("y"))
    lakes = stations(t).select("s_suppkey", F.array(*[corner(x, y) for x, y in _LAKE]).alias("ring"))
    return S.ring_join(pins(t), lakes, 40.0, 8.0).select("c_custkey", "s_suppkey", "inside", M.r6(col("to_shore")).alias("to_shore"))


#: The lake again, with an island of half its size, and a pond beside it.
_HOLE, _POND = [(x / 2, y / 2) for x, y in _LAKE], [(x / 4 + 60, y / 4 + 10) for x, y in _LAKE]
_RINGS16 = "[" + ", ".join("[" + ", ".join(f"{{'x': {QX} + {x}, 'y': {QY} + {y}}}" for x, y in ring) + "]" for ring in (_LAKE, _HOLE, _POND)) + "]"


@query(
    "jon_16_polygon_join",
    f"""WITH r AS (SELECT s_suppkey, {QX} AS qx, {QY} AS qy, unnest({_RINGS16}) AS ring FROM supplier), e AS (SELECT s_suppkey, qx, qy, ring[i].x AS x1, ring[i].y AS y1, ring[i % 4 + 1].x AS x2, ring[i % 4 + 1].y AS y2 FROM r, unnest([1, 2, 3, 4]) u(i)),
d AS (SELECT c_custkey, s_suppkey, ((y1 > {PY}) <> (y2 > {PY})) AND {PX} < x1 + (x2 - x1) * ({PY} - y1) / (y2 - y1) AS crossed, {PX} AS px, {PY} AS py, x1, y1, x2, y2,
  greatest(0.0, least(1.0, (({PX} - x1) * (x2 - x1) + ({PY} - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM customer, e WHERE {PX} BETWEEN qx - 120 AND qx + 120 AND {PY} BETWEEN qy - 120 AND qy + 120),
g AS (SELECT c_custkey, s_suppkey, count_if(crossed) % 2 = 1 AS inside, min(sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2))) AS away FROM d GROUP BY 1, 2)
SELECT c_custkey, s_suppkey, inside, CASE WHEN away <= 8 THEN {R("away")} END AS to_shore FROM g WHERE inside OR away <= 8""",
)
def _polygon_join(t):
    corner = lambda x, y: F.struct((col("qx") + x).alias("x"), (col("qy") + y).alias("y"))
    lakes = stations(t).select("s_suppkey", F.array(*[F.array(*[corner(x, y) for x, y in ring]) for ring in (_LAKE, _HOLE, _POND)]).alias("rings"))
    return S.polygon_join(pins(t), lakes, "c_custkey", "s_suppkey", 25.0, 8.0).withColumn("to_shore", M.r6(col("to_shore")))


def by_nation(t, most: float, where: str = "true"):
    """px, py, s_nationkey, best (dist, s_suppkey): for each distinct place of the pins the nearest station of each nation within `most`."""
    x = stations(t).join(t.supplier.filter(where).select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("qx", "qy", "s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return S.place_join(pins(t), x, most).groupBy("px", "py", "s_nationkey").agg(F.min(F.struct("dist", "s_suppkey")).alias("best"))


def same_first(t, most: float):
    """c_custkey, s_suppkey, named: the nearest station of the pin's own nation within `most` (named), else of any."""
    near = G._step(by_nation(t, most))
    any_ = near.groupBy("px", "py").agg(F.min("best").alias("best"))
    own = near.select("px", "py", col("s_nationkey").alias("c_nationkey"), col("best").alias("own"))
    x = pins(t).join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(any_, ["px", "py"]).join(own, ["px", "py", "c_nationkey"], "left")
    x = x.select("c_custkey", F.struct(col("own").isNull().alias("other"), F.coalesce("own", "best").alias("best")).alias("b")).groupBy("c_custkey").agg(F.min("b").alias("b"))
    return x.select("c_custkey", col("b.best.s_suppkey").alias("s_suppkey"), (~col("b.other")).alias("named"))


def at_pins(t, found, *columns):
    """What was found for distinct places (px, py), for every pin there."""
    return pins(t).dropDuplicates(["c_custkey"]).join(found, ["px", "py"]).select("c_custkey", *columns)


def two_kinds(t, most: float, first: str):
    """px, py, a, b: for each distinct place of the pins the distance of the nearest station for which `first` holds and of the nearest other one, one of them within `most`."""
    x = stations(t).join(t.supplier.select("s_suppkey", F.expr(first).alias("_first")), "s_suppkey").select("qx", "qy", "_first").distinct()
    d = lambda c: F.min(F.when(c, col("dist")))
    return S.place_join(pins(t), x, most).groupBy("px", "py").agg(d(col("_first")).alias("a"), d(~col("_first")).alias("b"))


query("geo_4_second_pass", f"SELECT c_custkey, arg_min(s_suppkey, (c_nationkey <> s_nationkey, {DIST}, s_suppkey)) AS s_suppkey FROM customer, supplier WHERE {DIST} <= 120 GROUP BY 1")(lambda t: same_first(t, 120.0).select("c_custkey", "s_suppkey"))
_BX, _BY = f"({QX} + s_suppkey % 7 * 20 - 60)", f"({QY} + s_suppkey % 5 * 30 - 45)"
_T = f"greatest(0.0, least(1.0, (({PX} - {QX}) * ({_BX} - {QX}) + ({PY} - {QY}) * ({_BY} - {QY})) / nullif(pow({_BX} - {QX}, 2) + pow({_BY} - {QY}, 2), 0)))"


@query("geo_5_along_line", f"SELECT c_custkey, s_suppkey, {R(f'coalesce({_T}, 0)')} AS frac, {R(f'{QX} + coalesce({_T}, 0) * ({_BX} - {QX})')} AS x, {R(f'{QY} + coalesce({_T}, 0) * ({_BY} - {QY})')} AS y FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1")
def _along(t):
    """The place on a reach (a segment from a station) that is nearest to each point: its fraction and its coordinates."""
    reach = stations(t).withColumns({"bx": col("qx") + col("s_suppkey") % 7 * 20 - 60, "by": col("qy") + col("s_suppkey") % 5 * 30 - 45})
    x = pins(t).withColumn("s_suppkey", col("c_custkey") % 10 + 1).join(reach, "s_suppkey")
    f = S.segment_distance(col("px"), col("py"), col("qx"), col("qy"), col("bx"), col("by"))[1]
    return x.withColumn("f", f).select("c_custkey", "s_suppkey", M.r6(col("f")).alias("frac"), M.r6(col("qx") + col("f") * (col("bx") - col("qx"))).alias("x"), M.r6(col("qy") + col("f") * (col("by") - col("qy"))).alias("y"))


query("geo_8_placement_reasons", f"SELECT c_custkey, concat_ws('; ', CASE WHEN {PX} < 100 THEN 'west' END, CASE WHEN {PY} > 900 THEN 'north' END) AS reasons FROM customer WHERE {PX} < 100 OR {PY} > 900")(lambda t: pins(t).select("c_custkey", F.concat_ws("; ", F.when(col("px") < 100, "west"), F.when(col("py") > 900, "north")).alias("reasons")).filter("reasons <> ''"))
query("geo_9_snap_to_set", f"SELECT c_custkey, arg_min(s_suppkey, ({DIST}, s_suppkey)) AS s_suppkey FROM customer, supplier WHERE {DIST} <= 200 AND s_nationkey < 5 GROUP BY 1")(lambda t: S.nearest_join(pins(t), stations(t).join(t.supplier.filter("s_nationkey < 5").select("s_suppkey"), "s_suppkey", "left_semi"), "c_custkey", "s_suppkey", 200.0).drop("dist"))
query("geo_10_inland", f"SELECT c_custkey, coalesce(min(CASE WHEN s_nationkey < 12 THEN {DIST} END) <= coalesce(min(CASE WHEN s_nationkey >= 12 THEN {DIST} END), 1e9), false) AS inland FROM customer, supplier WHERE {DIST} <= 150 GROUP BY 1")(lambda t: at_pins(t, two_kinds(t, 150.0, "s_nationkey < 12"), F.coalesce(col("a") <= F.coalesce("b", lit(1e9)), lit(False)).alias("inland")))

# --- folds of polls (streams) ------------------------------------------------------------------------------------

query("stm_3_keyed_fold", "SELECT user_id, ts::DATE AS day, count(*)::BIGINT AS n, bit_or(1::BIGINT << (hour(ts) * 2 + minute(ts) // 30)::INT) AS slots FROM events GROUP BY 1, 2")(lambda t: _fold(t))


def _fold(t):
    from fluvia.streaming.folds import coverage

    return coverage(t.events)


query("stm_2_latest_snapshot", "SELECT user_id, max(ts)::DATE AS day, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(day(F.max("ts")).alias("day"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status")))
_BY_COMPANY = "SELECT user_id % 3 AS company, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"


@query(
    "stm_4_carry_forward",
    f"""WITH g AS (SELECT company, day, n FROM (SELECT DISTINCT user_id % 3 AS company FROM events) CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM events) LEFT JOIN ({_BY_COMPANY}) USING (company, day)),
r AS (SELECT *, count(n) OVER (PARTITION BY company ORDER BY day) AS run FROM g)
SELECT company, day, coalesce(n, -3)::BIGINT AS n, CASE WHEN n IS NULL THEN min(CASE WHEN n IS NULL THEN day END) OVER (PARTITION BY company, run) END AS down_since FROM r""",
)
def _carried(t):
    """Days without a company's rows count as -3, since the first of them; a day with rows ends that."""
    days = t.events.agg(F.collect_set(day("ts")).alias("days"))  # one row, a calendar's days
    companies = t.events.select((col("user_id") % 3).alias("company")).distinct()
    seen = t.events.filter("event_type = 'purchase'").groupBy((col("user_id") % 3).alias("company"), day("ts").alias("day")).agg(F.count("*").alias("n"))
    grid = companies.crossJoin(F.broadcast(days)).select("company", F.explode("days").alias("day")).join(seen, ["company", "day"], "left")
    grid = grid.withColumn("run", F.count("n").over(Window.partitionBy("company").orderBy("day")))
    since = F.min(F.when(col("n").isNull(), col("day"))).over(Window.partitionBy("company", "run"))
    return grid.select("company", "day", F.coalesce("n", lit(-3)).cast("bigint").alias("n"), F.when(col("n").isNull(), since).alias("down_since"))


project("stm_5_tumbling_slot", "events", "event_id", {"slot": lambda: F.date_format(F.window(col("ts").cast("timestamp"), "30 minutes")["start"], "HH:mm")}, {"slot": "strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%H:%M')"})
#: A feed is stale beyond this age in hours.
STALE_H = 6


@query(
    "stm_6_freshness",
    f"""SELECT user_id, day, {R("(epoch(day + INTERVAL 1 DAY) - epoch(last)) / 3600")} AS age_h, coalesce((epoch(day + INTERVAL 1 DAY) - epoch(last)) / 3600 <= {STALE_H}, false) AS fresh FROM
(SELECT user_id, day, max(last) OVER (PARTITION BY user_id ORDER BY day) AS last FROM (SELECT user_id, ts::DATE AS day, max(ts) FILTER (event_type <> 'error') AS last FROM events GROUP BY 1, 2))""",
)
def _freshness(t):
    """The age, at the end of each day with polls, of what is last known; a feed without any time is stale."""
    x = t.events.groupBy("user_id", day("ts").alias("day")).agg(F.max(F.when(col("event_type") != "error", F.unix_micros(col("ts").cast("timestamp")))).alias("last"))
    x = x.withColumn("last", F.max("last").over(Window.partitionBy("user_id").orderBy("day")))
    age = (F.unix_micros(F.date_add("day", 1).cast("timestamp")) - col("last")) / 3_600_000_000
    return x.select("user_id", "day", M.r6(age).alias("age_h"), F.coalesce(age <= STALE_H, lit(False)).alias("fresh"))


query("stm_7_completeness", "SELECT user_id, ts::DATE AS day, CASE WHEN count(*) < 3 THEN 'few polls' WHEN max(hour(ts)) - min(hour(ts)) < 8 THEN 'short day' ELSE 'scored' END AS reason FROM events GROUP BY 1, 2")(lambda t: t.events.groupBy("user_id", day("ts").alias("day")).agg(F.when(F.count("*") < 3, "few polls").when(F.max(F.hour("ts")) - F.min(F.hour("ts")) < 8, "short day").otherwise("scored").alias("reason")))
query("stm_8_watermark", "SELECT user_id, min(ts)::DATE AS first_day FROM events WHERE ts::DATE <= DATE '2024-01-30' - 1 GROUP BY 1")(lambda t: t.events.filter(day("ts") <= F.date_sub(lit("2024-01-30").cast("date"), 1)).groupBy("user_id").agg(day(F.min("ts")).alias("first_day")))
@query("stm_9_old_state", "SELECT c_custkey, c_nationkey::BIGINT AS n_known, CASE WHEN c_custkey % 2 = 1 THEN c_nationkey ELSE 0 END::BIGINT AS n_stale FROM customer")
def _old_state(t):
    """State files of two versions read together: the older ones lack a column, which counts as 0."""
    state = t.customer.select("c_custkey", big(col("c_nationkey")).alias("n_known"), big(col("c_nationkey")).alias("n_stale"))
    old, new = G._step(state.filter("c_custkey % 2 = 0").drop("n_stale")), G._step(state.filter("c_custkey % 2 = 1"))
    both = t.spark.read.option("mergeSchema", "true").option("basePath", G.parent(new)).parquet(G.path_of(old), G.path_of(new))
    return both.select("c_custkey", "n_known", F.coalesce("n_stale", lit(0)).cast("bigint").alias("n_stale"))


query("stm_10_old_log_guard", "SELECT count(*)::BIGINT AS n FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE event_type = 'signup')")(lambda t: t.events.crossJoin(F.broadcast(t.events.filter("event_type = 'signup'").agg(F.min("ts").alias("first")))).filter("ts >= first").agg(F.count("*").alias("n")))
query("stm_11_alerts", "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER w AS before, count(*) FILTER (WHERE value >= 80) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 72000000000 PRECEDING AND 1 PRECEDING) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value >= 80 AND before < 80 AND recent = 0")(
    lambda t: t.events.select("event_id", "value", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"), F.count(F.when(col("value") >= 80, 1)).over(Window.partitionBy("user_id").orderBy(F.unix_micros(col("ts").cast("timestamp"))).rangeBetween(-72000000000, -1)).alias("recent")).filter("value >= 80 AND before < 80 AND recent = 0").select("event_id")
)
query("stm_12_rate_counters", "SELECT user_id, ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")(lambda t: t.events.groupBy("user_id", day("ts").alias("day")).agg(F.count("*").alias("n")).filter("n > 5"))
query("stm_13_ttl", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1")(lambda t: t.events.filter("ts >= '2024-01-29'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))
project("stm_14_close_open", "events", "event_id", {"ended": lambda: F.date_format(F.coalesce(F.when(col("event_type") != "error", col("ts")), lit("2024-02-01").cast("timestamp_ntz")), "yyyy-MM-dd")}, {"ended": "strftime(CASE WHEN event_type <> 'error' THEN ts ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d')"})

# --- models, evaluation, rules, entry points ---------------------------------------------------------------------

#: Shrinkage of a site's observed and expected counts. Fixed value.
SHRINK = 15


@query(
    "ml_3_site_offset",
    f"""WITH o AS (SELECT l_suppkey, ln((sum({Y}) + {SHRINK}) / (sum({PP}) + {SHRINK})) AS shift FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, {R(f"1 / (1 + exp(-(ln({PP} / (1 - {PP})) + shift)))")} AS p FROM lineitem JOIN o USING (l_suppkey)""",
)
def _site_offset(t):
    """Probabilities moved by their site's offset: the shrunken log ratio of what was seen there and what was expected."""
    o = t.lineitem.groupBy("l_suppkey").agg(F.log((F.sum(y()) + SHRINK) / (F.sum(pp()) + SHRINK)).alias("shift"))
    return t.lineitem.join(o, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", M.r6(M.sigmoid(M.logit(pp()) + col("shift"))).alias("p"))


query("ml_4_site_days", f"SELECT e.user_id, e.day, {R('1 / (1 + exp(-(coalesce(d.rain, 0) / 100 - 2)))')} AS p FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events) e LEFT JOIN {DAILY} d ON d.cell = e.user_id AND d.day = e.day")(lambda t: t.events.select(col("user_id").alias("cell"), day("ts").alias("day")).distinct().join(daily(t), ["cell", "day"], "left").select(col("cell").alias("user_id"), "day", M.r6(M.sigmoid(F.coalesce("rain", lit(0.0)) / 100 - 2)).alias("p")))
#: Weights of the standardised features, and the constant. Fixed values.
_WEIGHTS5, _CONST5 = {"l_quantity": 0.8, "l_tax": 0.3}, -1.2
_Z5 = " + ".join(f"{w} * ({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)" for c, w in _WEIGHTS5.items())


@query("ml_5_logistic", f"SELECT l_orderkey, l_linenumber, l_partkey, {R(f'1 / (1 + exp(-({_CONST5} + {_Z5})))')} AS p FROM lineitem")
def _logistic(t):
    """Scores by a model that is read as a JSON document: for each feature mean, deviation (of the whole population; 1 if zero) and weight."""
    sums = t.lineitem.agg(*[f(c).alias(f"{n}_{c}") for c in _WEIGHTS5 for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    feature = lambda c, w: F.struct(lit(c).alias("name"), col(f"mean_{c}").alias("mean"), F.when(col(f"std_{c}") == 0, 1.0).otherwise(col(f"std_{c}")).alias("std"), lit(w).alias("weight"))
    doc = sums.select(F.to_json(F.struct(lit(_CONST5).alias("constant"), F.array(*[feature(c, w) for c, w in _WEIGHTS5.items()]).alias("features"))).alias("doc"))
    model = G._step(doc).select(F.from_json("doc", "constant double, features array<struct<name string, mean double, std double, weight double>>").alias("model"))  # one row
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.create_map(*[e for c in _WEIGHTS5 for e in (lit(c), col(c))]).alias("x")).crossJoin(F.broadcast(model))
    z = F.aggregate("model.features", col("model.constant"), lambda a, f: a + f["weight"] * (F.element_at("x", f["name"]) - f["mean"]) / f["std"])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", M.r6(M.sigmoid(z)).alias("p"))


project("ml_8_features", "orders", "o_orderkey", {"x1": lambda: M.r6(F.log1p(col("o_totalprice"))), "x2": lambda: M.r6(M.logit(M.clip(col("o_totalprice") / 500000, 0.01, 0.99)))}, {"x1": R("ln(1 + o_totalprice)"), "x2": R("ln(least(greatest(o_totalprice / 500000, 0.01), 0.99) / (1 - least(greatest(o_totalprice / 500000, 0.01), 0.99)))")})
query("eva_4_scores_by_type", f"SELECT l_linenumber::BIGINT AS kind, CASE WHEN count(*) >= 30 THEN {R(f'avg(pow({PP} - {Y}, 2))')} END AS brier FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(big(col("l_linenumber")).alias("kind")).agg(F.when(F.count("*") >= 30, M.r6(F.avg(F.pow(pp() - y(), lit(2.0))))).alias("brier")))
query("eva_1_leave_one_out", f"SELECT l_suppkey, l_linenumber::BIGINT AS line, {R('CASE WHEN max(tn) > count(*) THEN (max(ts) - sum(y)) / (max(tn) - count(*)) END')} AS p FROM (SELECT l_suppkey, l_linenumber, {Y} AS y, sum({Y}) OVER (PARTITION BY l_linenumber) AS ts, count(*) OVER (PARTITION BY l_linenumber) AS tn FROM lineitem) GROUP BY 1, 2")(
    lambda t: (g := t.lineitem.groupBy("l_suppkey", big(col("l_linenumber")).alias("line")).agg(F.sum(y()).alias("s"), F.count("*").alias("n"))).select("l_suppkey", "line", "s", "n", F.sum("s").over(Window.partitionBy("line")).alias("ts"), F.sum("n").over(Window.partitionBy("line")).alias("tn")).select("l_suppkey", "line", M.r6(F.when(col("tn") > col("n"), (col("ts") - col("s")) / (col("tn") - col("n")))).alias("p"))
)
query("eva_5_availability", f"SELECT l_linenumber::BIGINT AS lead, {R('avg((l_tax > 0.02)::INT)')} AS share, {R('avg(CASE WHEN l_quantity > 25 THEN (l_tax > 0.02)::INT END)')} AS wet FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(big(col("l_linenumber")).alias("lead")).agg(M.r6(F.avg((col("l_tax") > 0.02).cast("int"))).alias("share"), M.r6(F.avg(F.when(col("l_quantity") > 25, (col("l_tax") > 0.02).cast("int")))).alias("wet")))
query("eva_7_capture", f"SELECT {R(f'sum(CASE WHEN rn <= n * 0.5 THEN y END) / sum(y)')} AS capture FROM (SELECT {Y}::DOUBLE AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)")(lambda t: t.lineitem.select(y().cast("double").alias("y"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(col("l_quantity").desc(), "l_orderkey", "l_linenumber", "l_extendedprice")).alias("rn"), F.count("*").over(Window.partitionBy("l_suppkey")).alias("n")).agg(M.r6(F.sum(F.when(col("rn") <= col("n") * 0.5, col("y"))) / F.sum("y")).alias("capture")))
project("eva_13_version_label", "orders", "o_orderkey", {"version": lambda: F.coalesce(F.when(col("o_orderstatus") == "F", "stamped"), F.concat(lit("before "), F.date_format("o_orderdate", "yyyy")))}, {"version": "coalesce(CASE WHEN o_orderstatus = 'F' THEN 'stamped' END, 'before ' || strftime(o_orderdate, '%Y'))"})
project("eva_14_feature_variant", "orders", "o_orderkey", {"x": lambda: M.r6(F.log1p(col("o_totalprice"))), "year": lambda: big(F.year("o_orderdate"))}, {"x": R("ln(1 + o_totalprice)"), "year": "year(o_orderdate)::BIGINT"})
_LV = "CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.04 THEN 2 ELSE 1 END"
_lv = lambda: F.when(col("l_discount") > 0.08, 3).when(col("l_discount") > 0.04, 2).otherwise(1)
project("rul_1_day_level", "lineitem", "l_orderkey, l_linenumber, l_partkey", {"level": lambda: big(F.greatest(_lv(), F.when(col("l_tax") > 0.06, 2).otherwise(0))), "by": lambda: F.when(_lv() >= F.when(col("l_tax") > 0.06, 2).otherwise(0), "spill").otherwise("water")}, {"level": f"greatest({_LV}, CASE WHEN l_tax > 0.06 THEN 2 ELSE 0 END)::BIGINT", "by": f"CASE WHEN {_LV} >= CASE WHEN l_tax > 0.06 THEN 2 ELSE 0 END THEN 'spill' ELSE 'water' END"})
project("rul_2_spot_level", "customer", "c_custkey", {"level": lambda: F.when(col("c_acctbal") < 0, "isolated").when(col("c_nationkey") == 0, "no forecast").when(col("c_acctbal") > 7000, "high").otherwise("low")}, {"level": "CASE WHEN c_acctbal < 0 THEN 'isolated' WHEN c_nationkey = 0 THEN 'no forecast' WHEN c_acctbal > 7000 THEN 'high' ELSE 'low' END"})
query("rul_3_later_worse_day", f"SELECT cell, min(day) AS day FROM (SELECT cell, day, rain, first_value(rain) OVER (PARTITION BY cell ORDER BY day) AS r0 FROM {DAILY}) WHERE rain > r0 GROUP BY 1")(lambda t: daily(t).select("cell", "day", "rain", F.first("rain").over(Window.partitionBy("cell").orderBy("day")).alias("r0")).filter("rain > r0").groupBy("cell").agg(F.min("day").alias("day")))
query("rul_4_headline", f"SELECT cell, day, CASE WHEN rain >= 200 THEN 'Wet' WHEN rain > 0 THEN 'Damp' ELSE 'Dry or unknown' END AS headline FROM {DAILY}")(lambda t: daily(t).select("cell", "day", F.when(col("rain") >= 200, "Wet").when(col("rain") > 0, "Damp").otherwise("Dry or unknown").alias("headline")))
query("rul_5_evidence_rows", "SELECT c_custkey, unnest(['balance', 'nation']) AS kind, unnest([c_acctbal::BIGINT, c_nationkey::BIGINT]) AS v FROM customer")(lambda t: t.customer.select("c_custkey", F.explode(F.array(F.struct(lit("balance").alias("kind"), F.rint("c_acctbal").cast("bigint").alias("v")), F.struct(lit("nation").alias("kind"), big(col("c_nationkey")).alias("v")))).alias("e")).select("c_custkey", "e.kind", "e.v"))
query("rul_9_attach", "SELECT s_suppkey, n_name, coalesce(m, 0)::BIGINT AS m FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS m FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) ON l_suppkey = s_suppkey")(lambda t: t.supplier.join(t.nation, col("n_nationkey") == col("s_nationkey"), "left").join(t.lineitem.filter("l_tax > 0.07").groupBy(col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("m")), "s_suppkey", "left").select("s_suppkey", "n_name", F.coalesce("m", lit(0)).cast("bigint").alias("m")))
query("api_2_box", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 90 BETWEEN 30 AND 50 ORDER BY 1 LIMIT 500")(lambda t: t.supplier.filter("s_suppkey % 90 BETWEEN 30 AND 50").select("s_suppkey").orderBy("s_suppkey").limit(500))
query("api_6_subscriptions", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")(lambda t: t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).filter("last <> 'error'"))
query("api_7_queue", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id, turn")(lambda t: t.conversations.filter("role = 'user'").select("conv_id", "turn").orderBy("conv_id", "turn"))

# --- the flagship: risk by root and day --------------------------------------------------------------------------

_RISK = f"""{UP}, src AS (SELECT root, node, dist, pow(10, -dist / 30) * least(1.0, 5000 / (dist + 5000)) AS w FROM up JOIN supplier ON s_suppkey = node),
p AS (SELECT cell, day, 1 / (1 + exp(-(coalesce(rain, 0) / 100 - 2))) AS p FROM {DAILY}),
s AS (SELECT root, (day + floor(dist / 24)::INT + k)::DATE AS day, node, p * w * CASE WHEN k = 0 THEN 1 - (dist / 24 - floor(dist / 24)) ELSE dist / 24 - floor(dist / 24) END AS x FROM src JOIN p ON cell = node % 150, unnest([0, 1]) u(k)),
g AS (SELECT root, day, node, least(sum(x), 1.0) AS x FROM s GROUP BY 1, 2, 3),
r AS (SELECT root, day, {R('1 - product(1 - x)')} AS risk FROM g GROUP BY 1, 2)
SELECT root, day, risk, CASE WHEN risk < 0.15 THEN 'low' WHEN risk < 0.4 THEN 'moderate' WHEN risk < 0.7 THEN 'high' ELSE 'very high' END AS label FROM r"""


def spot_risk(t, roots: str = "true", last: str | None = None):
    """Sources upstream of each root, their daily probability, moved by travel time, combined by noisy-or. Roots (a condition on suppliers) and
    the last day are passed to where the rows begin: nothing moves to an earlier day."""
    src = upstream(t, roots).join(t.supplier.select(col("s_suppkey").alias("node")), "node").withColumn("w", M.decay(col("dist")) * F.least(lit(1.0), lit(5000.0) / (col("dist") + 5000)))
    rain = daily(t) if last is None else daily(t, f"ts < DATE '{last}' + INTERVAL 1 DAY")
    p = rain.select("cell", "day", M.sigmoid(F.coalesce("rain", lit(0.0)) / 100 - 2).alias("p"))
    x = src.join(p, col("cell") == col("node") % 150).select("root", "node", "day", "dist", (col("p") * col("w")).alias("x"))
    x = T.travel_shift(x, "day", "dist", "x", ["root", "node"]).withColumn("x", F.least("x", lit(1.0)))
    return x.groupBy("root", "day").agg(M.r6(M.noisy_or(col("x"))).alias("risk")).withColumn("label", M.risk_label(col("risk")))


query("rul_7_spot_risk_by_day", _RISK)(spot_risk)
query("rul_6_point_risk", _RISK + " WHERE root = 25")(lambda t: spot_risk(t, "s_suppkey = 25"))
query("api_1_forecast", _RISK + " WHERE day <= DATE '2024-01-08'")(lambda t: spot_risk(t, last="2024-01-08").filter("day <= '2024-01-08'"))
