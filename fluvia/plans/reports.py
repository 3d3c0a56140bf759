"""Further networks and places, model fits, verification reports and packed sinks."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fluvia.functions import geo
from fluvia.functions import maths as M
from fluvia.operators import graph as G
from fluvia.operators import models
from fluvia.operators import spatial as S
from fluvia.operators.lines import simplify
from fluvia.plans.base import big, col, lit, project, query
from fluvia.plans.domain import DIST, EDGES, PX, PY, at_pins, by_nation, edges, pins, same_first, stations, two_kinds
from fluvia.plans.relational import DAILY, PP, R, Y, daily, day, pp, y

_cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.expr("substring(w, 2)") if w is None else F.substr(w, lit(2))))
project("str_6_label_parse", "part", "p_partkey", {"label": lambda: F.array_join(F.transform(F.split("p_type", " "), _cap), " ")}, {"label": "array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"})
_LAT17, _LON17 = "(50 + s_suppkey % 80 / 10.0)", "(-5 + s_suppkey % 60 / 10.0)"


@query("mth_17_projection", geo.to_grid_sql(f"SELECT s_suppkey, ({_LAT17})::DOUBLE AS lat, ({_LON17})::DOUBLE AS lon FROM supplier", "s_suppkey"))
def _projected(t):
    """Degrees to the grid and back again: the way back is right to a millionth of a degree."""
    x = t.supplier.select("s_suppkey", F.expr(_LAT17).cast("double").alias("lat"), F.expr(_LON17).cast("double").alias("lon"))
    east, north = geo.to_grid(col("lat"), col("lon"))
    x = x.withColumn("east", east).withColumn("north", north)
    lat, lon = geo.from_grid(col("east"), col("north"))
    back = (F.abs(lat - col("lat")) < 1e-6) & (F.abs(lon - col("lon")) < 1e-6)
    return x.select("s_suppkey", F.round("east", 1).alias("east"), F.round("north", 1).alias("north"), back.alias("back"))


_BY_RANK = f"SELECT row_number() OVER (ORDER BY c_acctbal::BIGINT DESC, c_custkey) AS i, c_custkey AS k, {PX} AS x, {PY} AS y FROM customer"


@query(
    "srt_11_greedy_dedupe",
    f"""WITH RECURSIVE o AS ({_BY_RANK}), w AS (SELECT 0::BIGINT AS i, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] AS kept
UNION ALL SELECT o.i, CASE WHEN len(list_filter(kept, lambda q: sqrt(pow(q.x - o.x, 2) + pow(q.y - o.y, 2)) <= 20)) = 0 THEN list_append(kept, {{'k': o.k, 'x': o.x, 'y': o.y}}) ELSE kept END FROM w JOIN o ON o.i = w.i + 1)
SELECT u.v.k AS c_custkey FROM (SELECT kept FROM w ORDER BY i DESC LIMIT 1), unnest(kept) AS u(v)""",
)
def _best_pins(t):
    return S.greedy_dedupe(pins(t).join(t.customer.select("c_custkey", big(F.rint("c_acctbal")).alias("rank")), "c_custkey"), "c_custkey", "rank", 20.0).select("c_custkey")



query("grf_3_gap_repair", f"SELECT c_custkey AS head, arg_min(s_suppkey, ({DIST}, s_suppkey)) AS sink FROM customer, supplier WHERE {DIST} <= 60 AND s_acctbal >= 1000 AND c_nationkey <> s_nationkey GROUP BY 1")(lambda t: _gap_repair(t))


def _gap_repair(t):
    """The nearest sink of another nation: of a place's two nearest nations one is another."""
    two = by_nation(t, 60.0, "s_acctbal >= 1000").filter("s_nationkey IS NOT NULL").groupBy("px", "py").agg(F.slice(F.array_sort(F.collect_list(F.struct("best", "s_nationkey"))), 1, 2).alias("two"))
    x = pins(t).join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(two, ["px", "py"])
    x = x.select("c_custkey", F.get(F.filter("two", lambda n: n["s_nationkey"] != col("c_nationkey")), lit(0))["best"].alias("best"))
    return x.filter("best IS NOT NULL").groupBy(col("c_custkey").alias("head")).agg(F.min("best").alias("best")).select("head", col("best.s_suppkey").alias("sink"))


_ANC = f"WITH RECURSIVE a AS (SELECT src AS node, dst AS top, length FROM {EDGES} UNION ALL SELECT node, e.dst, a.length FROM a JOIN {EDGES} e ON e.src = a.top)"
query("grf_4_accumulated_length", _ANC + f" SELECT top AS node, {R('sum(length)')} AS upstream FROM a GROUP BY 1")(lambda t: G.accumulate(edges(t)).filter("upstream > 0").select("node", M.r6(col("upstream")).alias("upstream")))
_LAKE = "src // 300 AS lake, dst // 300 AS below"


@query("grf_10_lake_outlet", f"SELECT lake, arg_max(src, (length, src)) AS outlet FROM (SELECT src, length, {_LAKE} FROM {EDGES}) WHERE lake <> below GROUP BY 1")
def _lake_outlets(t):
    """Of the links that leave a lake (a range of 300 links), the longest."""
    x = edges(t).withColumn("lake", F.floor(col("src") / 300)).withColumn("below", F.floor(col("dst") / 300))
    return x.filter("lake <> below").groupBy("lake").agg(F.max_by("src", F.struct("length", "src")).alias("outlet"))


_WALK = f"WITH RECURSIVE w AS (SELECT p_partkey AS root, p_partkey AS node, 0.0::DOUBLE AS dist FROM part UNION ALL SELECT root, e.dst, dist + length FROM w JOIN {EDGES} e ON e.src = w.node)"
# up from the few nodes that are asked for, not down from all parts
_above = lambda t, nodes: G.closure(edges(t), t.part.filter(nodes).select(col("p_partkey").alias("node")), 1e9).select(col("node").alias("root"), col("root").alias("node"), "dist")
query("grf_11_path_to_lake", _WALK + f" SELECT root, arg_min(node, dist) AS entry, {R('min(dist)')} AS dist FROM w WHERE node BETWEEN 100 AND 130 GROUP BY 1")(lambda t: _above(t, "p_partkey BETWEEN 100 AND 130").groupBy("root").agg(F.min_by("node", "dist").alias("entry"), M.r6(F.min("dist")).alias("dist")))
query("grf_13_along_river", _WALK + f" SELECT root, node, {R('dist')} AS metres FROM w WHERE node IN (3, 60, 61)")(lambda t: _above(t, "p_partkey IN (3, 60, 61)").select("root", "node", M.r6(col("dist")).alias("metres")))

query("geo_1_pin_location", f"SELECT c_custkey, CASE WHEN min(CASE WHEN s_nationkey < 8 THEN {DIST} END) * 0.5 < coalesce(min(CASE WHEN s_nationkey >= 8 THEN {DIST} END), 1e9) THEN 'lake' ELSE 'river' END AS kind FROM customer, supplier WHERE {DIST} <= 100 GROUP BY 1")(lambda t: at_pins(t, two_kinds(t, 100.0, "s_nationkey < 8"), F.when(col("a") * 0.5 < F.coalesce("b", lit(1e9)), "lake").otherwise("river").alias("kind")))
query("geo_2_name_hint", f"SELECT c_custkey, arg_min(s_suppkey, (s_nationkey <> c_nationkey, {DIST}, s_suppkey)) AS link, bool_or(s_nationkey = c_nationkey) AS named FROM customer, supplier WHERE {DIST} <= 90 GROUP BY 1")(lambda t: same_first(t, 90.0).select("c_custkey", col("s_suppkey").alias("link"), "named"))
query("geo_3_main_channel", f"SELECT c_custkey, CASE WHEN arg_min(s_acctbal, ({DIST}, s_suppkey)) < 3000 AND max(s_acctbal) >= greatest(5000, 5 * arg_min(s_acctbal, ({DIST}, s_suppkey))) THEN arg_max(s_suppkey, (s_acctbal, s_suppkey)) ELSE arg_min(s_suppkey, ({DIST}, s_suppkey)) END AS link FROM customer, supplier WHERE {DIST} <= 90 GROUP BY 1")(lambda t: _main_channel(t))


def _main_channel(t):
    """The nearest station, or if it is small and a far greater one lies near, the greatest: of the stations at one place only the first and the greatest count."""
    x = stations(t).join(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey")
    x = x.groupBy("qx", "qy").agg(F.min(F.struct("s_suppkey", "s_acctbal")).alias("near"), F.max(F.struct("s_acctbal", "s_suppkey")).alias("top"))
    x = S.place_join(pins(t), x, 90.0).groupBy("px", "py").agg(F.min(F.struct("dist", "near"))["near"].alias("near"), F.max("top").alias("top"))
    main = (col("near.s_acctbal") < 3000) & (col("top.s_acctbal") >= F.greatest(lit(5000.0), 5 * col("near.s_acctbal")))
    return at_pins(t, x, F.when(main, col("top.s_suppkey")).otherwise(col("near.s_suppkey")).alias("link"))


query("geo_6_simplify")(lambda t: _simplified(t))


def _simplified(t):
    def run(pdf):
        pdf = pdf.sort_values("c_custkey")
        out = simplify(list(zip(pdf.px, pdf.py, strict=True)), 50.0)
        return pdf.head(1)[["line"]].assign(n=len(pdf), kept=len(out))

    # lines of 40 points, so that lines and not their points grow with the input
    return pins(t).withColumn("line", F.floor(col("c_custkey") / 40)).groupBy("line").applyInPandas(run, "line long, n long, kept long")


_X = ["l_quantity", "l_tax", "l_discount"]
_rows = lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", *_X, y().alias("label"))
@query("ml_1_boosted_fit")
def _boosted_fit(t):
    """Every row's probability by trees that rise with the quantity."""
    m = models.boosted(_rows(t), _X, "label", ["l_orderkey", "l_linenumber"], [1, 0, 0])
    return _rows(t).select("l_orderkey", "l_linenumber", F.round(m.probability(), 6).alias("p"))


query("ml_2_predict_clipped")(lambda t: models.scored(models.logistic(_rows(t), _X, "label"), _rows(t), _X).select("l_orderkey", "l_linenumber", F.round("p", 4).alias("p")))
query("ml_6_logistic_fit")(lambda t: t.spark.createDataFrame([[float(c) for c in models.logistic(_rows(t), _X, "label").coefficients]], [f"c_{x}" for x in _X]))
query("ml_7_isotonic_knots")(lambda t: t.spark.createDataFrame(list(zip(*models.isotonic(_rows(t), "l_discount", "label"), strict=True)), "x double, y double"))
query("ml_9_train_test")(lambda t: models.scored(models.logistic(_rows(t).filter("l_orderkey % 2 = 0"), _X, "label"), _rows(t).filter("l_orderkey % 2 = 1"), _X).agg(F.count("*").alias("n"), F.avg(F.pow(col("p") - col("label"), lit(2.0))).alias("brier")))
query("eva_2_within_site_slope", f"SELECT l_suppkey, {R('regr_slope(l_extendedprice, l_quantity)')} AS slope FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(M.r6(F.regr_slope("l_extendedprice", "l_quantity")).alias("slope")))
query("eva_3_cluster_bootstrap")(lambda t: models.cluster_bootstrap(t.lineitem.select("l_suppkey", F.pow(pp() - y(), lit(2.0)).alias("e")), "l_suppkey", "e"))
query("eva_6_rain_at_samples", f"SELECT e.event_id, k::BIGINT AS lead, {R('d.rain')} AS rain FROM events e, unnest([0, 1, 2]) u(k) LEFT JOIN {DAILY} d ON d.cell = e.user_id AND d.day = e.ts::DATE - k WHERE e.event_type = 'signup'")(lambda t: t.events.filter("event_type = 'signup'").select("event_id", col("user_id").alias("cell"), day("ts").alias("d0"), F.explode(F.array(lit(0), lit(1), lit(2))).alias("lead")).withColumn("day", F.date_sub("d0", col("lead"))).join(daily(t), ["cell", "day"], "left").select("event_id", big(col("lead")).alias("lead"), M.r6(col("rain")).alias("rain")))
query("eva_8_exposure", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY 1")(lambda t: t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select(col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey", "left").groupBy("o_orderkey").agg(F.count_if((col("l_shipdate") >= col("o_orderdate")) & (col("l_shipdate") <= col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))).alias("n")))
query("eva_9_lead_replay", f"SELECT l_linenumber::BIGINT AS lead, count(*)::BIGINT AS n, {R(f'avg(pow(1 / (1 + exp(-(l_quantity / 20 - 2 - 0.1 * l_linenumber))) - {Y}, 2))')} AS brier FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy(big(col("l_linenumber")).alias("lead")).agg(F.count("*").alias("n"), M.r6(F.avg(F.pow(M.sigmoid(col("l_quantity") / 20 - 2 - 0.1 * col("l_linenumber")) - y(), lit(2.0)))).alias("brier")))
#: A user's day is scored if a forecast (a click, its value as a percentage) came before LATEST and at least POLLS polls cover the day.
LATEST, POLLS = 9, 3
_JUDGED = f"""SELECT *, CASE WHEN p IS NULL THEN 'missed deadline' WHEN polls < {POLLS} THEN 'few polls' ELSE 'scored' END AS reason FROM (
SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) FILTER (event_type = 'click' AND hour(ts) < {LATEST}) / 100 AS p,
  count_if(event_type = 'click') AS issues, count(*) AS polls, max((event_type = 'error')::INT) AS y FROM events GROUP BY 1, 2) WHERE issues > 0"""


def _judged(t):
    """user_id, day, p (of the last forecast in time), y (what was seen) and the reason why a candidate is scored or not."""
    in_time = (col("event_type") == "click") & (F.hour("ts") < LATEST)
    x = t.events.groupBy("user_id", day("ts").alias("day")).agg(
        (F.max_by(F.when(in_time, col("value")), F.when(in_time, F.struct("ts", "event_id"))) / 100).alias("p"), F.count_if(col("event_type") == "click").alias("issues"),
        F.count("*").alias("polls"), F.max((col("event_type") == "error").cast("int")).alias("y"),
    )
    reason = F.when(col("p").isNull(), "missed deadline").when(col("polls") < POLLS, "few polls").otherwise("scored")
    return x.filter("issues > 0").withColumn("reason", reason)


_LIVE = f"""SELECT reason, count(*)::BIGINT AS n, {R("avg(CASE WHEN reason = 'scored' THEN pow(p - y, 2) END)")} AS brier,
{R("CASE WHEN reason = 'scored' THEN avg(y) * (1 - avg(y)) END")} AS base_rate_brier, count_if(reason = 'scored' AND (p >= 0.5) = (y = 1))::BIGINT AS hits FROM ({_JUDGED}) GROUP BY 1"""


@query("eva_10_live_report", _LIVE)
def _live_report(t):
    """Candidates by the reason why they are scored or not, with the scores of those that are."""
    scored, share = col("reason") == "scored", F.avg("y")
    return _judged(t).groupBy("reason").agg(
        F.count("*").alias("n"), M.r6(F.avg(F.when(scored, F.pow(col("p") - col("y"), lit(2.0))))).alias("brier"),
        M.r6(F.when(scored, share * (1 - share))).alias("base_rate_brier"), F.count_if(scored & ((col("p") >= 0.5) == (col("y") == 1))).alias("hits"),
    )


@query(
    "eva_11_sample_report",
    f"""WITH s AS (SELECT o_orderstatus AS kind, (o_totalprice > 150000)::INT AS y, lag(least(o_totalprice / 500000, 1)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT kind, count(*)::BIGINT AS samples, count(p)::BIGINT AS scored, {R("avg(pow(p - y, 2))")} AS brier, {R("avg(CASE WHEN p IS NOT NULL THEN y END) * (1 - avg(CASE WHEN p IS NOT NULL THEN y END))")} AS base_rate_brier FROM s GROUP BY 1""",
)
def _sample_report(t):
    """Samples by kind against the estimate in force strictly before each, where there is one."""
    from pyspark.sql import Window

    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select(col("o_orderstatus").alias("kind"), (col("o_totalprice") > 150000).cast("int").alias("y"), F.lag(F.least(col("o_totalprice") / 500000, lit(1.0))).over(before).alias("p"))
    share = F.avg(F.when(col("p").isNotNull(), col("y")))
    return x.groupBy("kind").agg(F.count("*").alias("samples"), F.count("p").alias("scored"), M.r6(F.avg(F.pow(col("p") - col("y"), lit(2.0)))).alias("brier"), M.r6(share * (1 - share)).alias("base_rate_brier"))


_THEIRS = "least(l_discount * 8, 1)"


@query(
    "eva_12_comparison",
    f"""SELECT l_returnflag, count(*)::BIGINT AS n, {R(f"avg(pow({PP} - {Y}, 2))")} AS ours, {R(f"avg(pow({_THEIRS} - {Y}, 2))")} AS theirs, {R(f"avg(pow({PP} - {Y}, 2) - pow({_THEIRS} - {Y}, 2))")} AS gap,
count_if(({PP} >= 0.5) = ({Y} = 1) AND ({_THEIRS} >= 0.5) <> ({Y} = 1))::BIGINT AS only_ours, count_if(({PP} >= 0.5) <> ({Y} = 1) AND ({_THEIRS} >= 0.5) = ({Y} = 1))::BIGINT AS only_theirs FROM lineitem GROUP BY 1""",
)
def _comparison(t):
    """Two predictions of the same samples: their scores, the paired gap, and how often only one was right."""
    theirs = F.least(col("l_discount") * 8, lit(1.0))
    ours_right, theirs_right = (pp() >= 0.5) == (y() == 1), (theirs >= 0.5) == (y() == 1)
    a, b = F.pow(pp() - y(), lit(2.0)), F.pow(theirs - y(), lit(2.0))
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), M.r6(F.avg(a)).alias("ours"), M.r6(F.avg(b)).alias("theirs"), M.r6(F.avg(a - b)).alias("gap"), F.count_if(ours_right & ~theirs_right).alias("only_ours"), F.count_if(~ours_right & theirs_right).alias("only_theirs"))


@query(
    "rul_8_placement",
    f"""WITH n AS (SELECT c_custkey, arg_min(s_suppkey, ({DIST}, s_suppkey)) AS station, {R(f"min({DIST})")} AS dist FROM customer, supplier WHERE {DIST} <= 60 GROUP BY 1)
SELECT c_custkey, CASE WHEN {PX} < 50 OR {PY} < 50 THEN 'outside' WHEN station IS NULL THEN 'no river near' WHEN c_acctbal < 0 THEN 'review' ELSE 'placed' END AS answer, station, dist FROM customer LEFT JOIN n USING (c_custkey)""",
)
def _placement(t):
    """A request's point on the nearest station within 60, or the reason why it is not placed."""
    near = S.nearest_join(pins(t), stations(t), "c_custkey", "s_suppkey", 60.0).select("c_custkey", col("s_suppkey").alias("station"), M.r6(col("dist")).alias("dist"))
    answer = F.when((col("px") < 50) | (col("py") < 50), "outside").when(col("station").isNull(), "no river near").when(col("c_acctbal") < 0, "review").otherwise("placed")
    return pins(t).join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey").join(near, "c_custkey", "left").select("c_custkey", answer.alias("answer"), "station", "dist")


@query(
    "api_4_verification_document",
    f"""SELECT '{{"candidates":' || sum(n) || ',"scored":' || coalesce(sum(n) FILTER (reason = 'scored'), 0) || ',"missed":' || coalesce(sum(n) FILTER (reason = 'missed deadline'), 0) || ',"hits":' || sum(hits) || '}}' AS doc FROM ({_LIVE})""",
)
def _document(t):
    """The live report as one document."""
    of = lambda reason: F.coalesce(F.sum(F.when(col("reason") == reason, col("n"))), lit(0))
    doc = _live_report(t).agg(F.sum("n").alias("candidates"), of("scored").alias("scored"), of("missed deadline").alias("missed"), F.sum("hits").alias("hits"))
    return doc.select(F.to_json(F.struct("candidates", "scored", "missed", "hits")).alias("doc"))


query("snk_7_packed_index")(lambda t: _packed(t))


def _packed(t):
    """Little-endian 32-bit ids of a tile, in one binary value."""

    def run(pdf):
        ids = sorted(pdf.s_suppkey)
        return pdf.head(1)[["tile"]].assign(n=len(ids), block=[struct.pack(f"<{len(ids)}i", *ids)])

    return t.supplier.select(F.floor(col("s_suppkey") / 64).alias("tile"), "s_suppkey").groupBy("tile").applyInPandas(run, "tile long, n long, block binary")


query("snk_16_evolved_schema", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'v2' END, 'v1') AS version FROM orders")(lambda t: t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", lit("v2").alias("version")).unionByName(t.orders.filter("o_orderkey % 2 <> 0").select("o_orderkey"), allowMissingColumns=True).select("o_orderkey", F.coalesce("version", lit("v1")).alias("version")))
