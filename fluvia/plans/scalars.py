"""Scalar functions: text, dates, maths, arrays, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvia.functions import maths as M
from fluvia.functions import text as X
from fluvia.functions import times as D
from fluvia.plans.base import big, col, lit, project, query

# --- text --------------------------------------------------------------------------------------------------------

NAME = "part"
project("str_1_norm_name", NAME, "p_partkey", {"norm": lambda: X.norm_name(F.concat(col("p_name"), lit(" (#"), col("p_brand"), lit(")")))}, {"norm": "trim(regexp_replace(upper(coalesce(p_name || ' (#' || p_brand || ')', '')), '[^A-Z0-9]+', ' ', 'g'))"})
_W = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]{{2,}}'), lambda w: w NOT IN ('river','stream','brook','the','of','and','upper','lower'))))"
project("str_2_distinctive_words", "documents", "doc_id", {"words": lambda: F.array_join(F.sort_array(X.distinctive_words(col("text"))), " ")}, {"words": "coalesce(array_to_string(" + _W.format("text") + ", ' '), '')"})
project("str_3_same_river", NAME, "p_partkey", {"same": lambda: X.share_word(col("p_name"), F.concat_ws(" ", lit("upper hot"), col("p_type")))}, {"same": "list_has_any(" + _W.format("p_name") + ", " + _W.format("'upper hot ' || p_type") + ")"})
project("str_4_tokens", NAME, "p_partkey", {"tokens": lambda: F.array_join(F.sort_array(X.tokens(F.concat(col("p_name"), lit(" (drop this) the tidal "), col("p_type")), ("the", "tidal"))), " ")}, {"tokens": "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(p_name || ' (drop this) the tidal ' || p_type, '\\(.*?\\)', ' ', 'g')), '[a-z]{3,}'), lambda w: w NOT IN ('the','tidal')))), ' ')"})
project("str_5_id_format", "customer", "c_custkey", {"is_current": lambda: F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lpad(col("c_custkey").cast("string"), 5, "0")).rlike("^[A-Z]{3}[0-9]{5}$"), "is_old": lambda: F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), col("c_custkey").cast("string")).rlike("^[A-Z]{2,3}[0-9]{4}$")}, {"is_current": "regexp_matches(upper(c_mktsegment[1:3]) || lpad(c_custkey::VARCHAR, 5, '0'), '^[A-Z]{3}[0-9]{5}$')", "is_old": "regexp_matches(upper(c_mktsegment[1:2]) || c_custkey::VARCHAR, '^[A-Z]{2,3}[0-9]{4}$')"})
project("str_7_named_water", "documents", "doc_id", {"first_word": lambda: F.get(F.filter(F.split("text", "[ ,.\\n]+"), lambda w: F.length(w) > 5), lit(0))}, {"first_word": "list_filter(string_split_regex(text, '[ ,.\\n]+'), lambda w: length(w) > 5)[1]"})
query("str_8_slug", """WITH s AS (SELECT p_partkey, array_to_string(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), '-')[1:4], '-') AS slug FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END AS spot_id FROM s WINDOW w AS (PARTITION BY slug ORDER BY p_partkey)""")(
    lambda t: _slugs(t.part)
)


def _slugs(part):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return part.select("p_partkey", X.slug(col("p_name")).alias("slug")).select("p_partkey", F.when(n == 1, col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("spot_id"))


_PLACE = "'at ' || s_acctbal || ', ' || (s_suppkey % 90) || '.25'"
project("str_9_parse_location", "supplier", "s_suppkey", {"lat": lambda: F.regexp_extract(F.concat(lit("at "), (col("s_suppkey") % 60).cast("string"), lit(".5, -"), (col("s_suppkey") % 9).cast("string"), lit(".25")), r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)", 1).try_cast("double"), "lon": lambda: F.regexp_extract(F.concat(lit("at "), (col("s_suppkey") % 60).cast("string"), lit(".5, -"), (col("s_suppkey") % 9).cast("string"), lit(".25")), r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)", 2).try_cast("double")}, {"lat": r"try_cast(regexp_extract('at ' || (s_suppkey % 60) || '.5, -' || (s_suppkey % 9) || '.25', '(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)', 1) AS DOUBLE)", "lon": r"try_cast(regexp_extract('at ' || (s_suppkey % 60) || '.5, -' || (s_suppkey % 9) || '.25', '(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)', 2) AS DOUBLE)"})
project("str_10_clean", "conversations", "conv_id, turn", {"body": lambda: X.clean(col("text"))}, {"body": r"trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g'))[1:200]"})
project("str_11_stop_list", NAME, "p_partkey", {"dropped": lambda: col("p_name").rlike(r"(?i)\b(pool|gear|disused|sea)\b")}, {"dropped": r"regexp_matches(p_name, '(?i)\b(pool|gear|disused|sea)\b')"})
project("str_12_cell_key", "supplier", "s_suppkey", {"cell": lambda: F.format_string("%.3f_%.3f", (50 + col("s_suppkey") % 90 / lit(10.0)), (-1 - col("s_suppkey") % 70 / lit(10.0)))}, {"cell": "printf('%.3f_%.3f', 50 + s_suppkey % 90 / 10.0, -1 - s_suppkey % 70 / 10.0)"})
project("str_13_tile_key", "supplier", "s_suppkey", {"tile": lambda: F.concat_ws("_", F.floor((50 + col("s_suppkey") % 90 / lit(16.0)) / 0.25).cast("string"), F.floor((-1 - col("s_suppkey") % 70 / lit(16.0)) / 0.25).cast("string"))}, {"tile": "floor((50 + s_suppkey % 90 / 16.0) / 0.25)::BIGINT || '_' || floor((-1 - s_suppkey % 70 / 16.0) / 0.25)::BIGINT"})
project("str_14_content_hash", "documents", "doc_id", {"version": lambda: X.content_hash(col("text"))}, {"version": "sha256(text)[1:12]"})
project("str_15_web_address", "pages", "page_id", {"has_address": lambda: col("html").rlike(r"https?://|www\.")}, {"has_address": r"regexp_matches(html, 'https?://|www\.')"})
project("str_16_sentence", "orders", "o_orderkey", {"sentence": lambda: F.concat(lit("Order "), col("o_orderkey").cast("string"), F.when(col("o_orderstatus") == "F", " is closed").when(col("o_orderstatus") == "O", " is open").otherwise(" is pending"), lit("."))}, {"sentence": "'Order ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' is closed' WHEN o_orderstatus = 'O' THEN ' is open' ELSE ' is pending' END || '.'"})
project("str_17_connection_key", "customer", "c_custkey", {"conn": lambda: X.connection_key(F.when(col("c_custkey") % 2 == 0, F.concat(lit("10.0.0."), (col("c_custkey") % 200).cast("string"))).otherwise(F.concat(lit("2001:db8:1:"), (col("c_custkey") % 100).cast("string"), lit(":5:6:7:8"))))}, {"conn": "CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || (c_custkey % 200) ELSE array_to_string(string_split('2001:db8:1:' || (c_custkey % 100) || ':5:6:7:8', ':')[1:4], ':') END"})

# --- dates -------------------------------------------------------------------------------------------------------

O, OD = "orders", "o_orderdate::DATE"
d = lambda: col("o_orderdate").cast("date")
project("dt_1_floor", "events", "event_id", {"day": lambda: F.to_date("ts"), "hour": lambda: F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")}, {"day": "ts::DATE", "hour": "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M')"})
project("dt_2_year_angle", O, "o_orderkey", {"doy_sin": lambda: M.r6(F.sin(D.year_angle(d()))), "doy_cos": lambda: M.r6(F.cos(D.year_angle(d())))}, {"doy_sin": f"round(sin(2 * pi() * dayofyear({OD}) / 365.25) + 1e-9, 6)", "doy_cos": f"round(cos(2 * pi() * dayofyear({OD}) / 365.25) + 1e-9, 6)"})
project("dt_3_season_day", O, "o_orderkey", {"season_day": lambda: big(D.season_day(d()))}, {"season_day": f"CASE WHEN month({OD}) >= 10 OR month({OD}) = 1 THEN dayofyear(make_date(year({OD}), 9, 30)) WHEN month({OD}) < 5 THEN dayofyear(make_date(year({OD}), 5, 1)) ELSE dayofyear({OD}) END::BIGINT"})
project("dt_4_season_start", O, "o_orderkey", {"start": lambda: D.season_start(d())}, {"start": f"make_date(year({OD}) - (month({OD}) < 5)::BIGINT, 5, 1)"})
project("dt_5_local_slot", "events", "event_id", {"local_day": lambda: F.to_date(D.local(col("ts"))), "slot": lambda: big(D.slot(D.local(col("ts"))))}, {"local_day": "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')::DATE", "slot": "(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') * 2 + minute(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') // 30)::BIGINT"})
query("dt_6_lead_days", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(lambda t: t.lineitem.join(t.orders, col("l_orderkey") == col("o_orderkey")).select("l_orderkey", "l_linenumber", big(F.datediff("l_shipdate", "o_orderdate")).alias("lead")))
project("dt_7_deadline", "events", "event_id", {"in_time": lambda: D.local(col("ts")) <= F.date_trunc("day", D.local(col("ts"))) + F.expr("INTERVAL 8 HOURS")}, {"in_time": "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') <= date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') + INTERVAL 8 HOUR"})
project("dt_8_week_start", O, "o_orderkey", {"week": lambda: F.to_date(F.date_trunc("week", d()))}, {"week": f"date_trunc('week', {OD})::DATE"})
project("dt_9_iso_week", O, "o_orderkey", {"week": lambda: D.iso_week(d())}, {"week": f"strftime({OD}, '%G-%V')"})
project("dt_10_age_hours", "events", "event_id", {"age_h": lambda: M.r6(D.age_hours(F.to_timestamp(lit("2024-02-01 00:00:00")), col("ts")))}, {"age_h": "round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3.6e9 + 1e-9, 6)"})
_SPAN = "SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_orderkey % 80)::INT - 5))::DATE AS b FROM orders"
query("dt_11_explode_span", f"SELECT o_orderkey, unnest(generate_series(a, greatest(a, least(b, a + 60)), INTERVAL 1 DAY))::DATE AS day FROM ({_SPAN})")(lambda t: t.orders.select("o_orderkey", F.explode(D.span_days(col("o_orderdate"), F.date_add(d(), (col("o_orderkey") % 80).cast("int") - 5))).alias("day")))
query("dt_12_open_spans", "SELECT DISTINCT user_id, unnest(generate_series(a::DATE, greatest(a::DATE, b::DATE), INTERVAL 1 DAY))::DATE AS day FROM (SELECT user_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS a, coalesce(CASE WHEN event_type <> 'error' THEN ts + INTERVAL 30 HOUR END, ts + INTERVAL 50 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS b FROM events)")(
    lambda t: t.events.select("user_id", D.local(col("ts")).alias("a"), D.local(F.coalesce(F.when(col("event_type") != "error", col("ts") + F.expr("INTERVAL 30 HOURS")), col("ts") + F.expr("INTERVAL 50 HOURS"))).alias("b")).select("user_id", F.explode(D.span_days(col("a"), col("b"))).alias("day")).distinct()
)
query("dt_13_history_days", "SELECT l_suppkey, greatest(1, ceil(max(l_quantity * 2) / 24)::BIGINT + 1)::BIGINT AS days FROM lineitem GROUP BY l_suppkey")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.greatest(lit(1).cast("bigint"), big(F.ceil(F.max(col("l_quantity") * 2) / 24)) + 1).alias("days")))
project("dt_14_day_grid", "supplier", "s_suppkey", {"day": lambda: F.explode(F.sequence(F.date_sub(lit("2024-01-10").cast("date"), (col("s_suppkey") % 5).cast("int")), F.date_add(lit("2024-01-10").cast("date"), 3)))}, {"day": "unnest(generate_series(DATE '2024-01-10' - (s_suppkey % 5)::INT, DATE '2024-01-13', INTERVAL 1 DAY))::DATE"})
_LON = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')"
project("dt_15_expiry", "events", "event_id", {"expires": lambda: F.date_format(F.least(col("ts").cast("timestamp") + F.expr("INTERVAL 8 HOURS"), F.to_utc_timestamp(F.date_add(F.to_date(D.local(col("ts"))), 1).cast("timestamp"), D.ZONE)), "yyyy-MM-dd HH:mm:ss")}, {"expires": f"strftime(least(ts + INTERVAL 8 HOUR, (({_LON}::DATE + 1)::TIMESTAMP AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC')), '%Y-%m-%d %H:%M:%S')"})
project("dt_16_bathing_season", O, "o_orderkey", {"in_season": lambda: F.date_format("o_orderdate", "MM-dd").between("05-15", "09-30")}, {"in_season": "strftime(o_orderdate, '%m-%d') BETWEEN '05-15' AND '09-30'"})
project("dt_17_month_parity", O, "o_orderkey", {"fold": lambda: big(F.month("o_orderdate") % 2)}, {"fold": "(month(o_orderdate) % 2)::BIGINT"})
project("dt_18_span_words", O, "o_orderkey", {"span": lambda: F.concat(F.date_format("o_orderdate", "dd/MM"), lit(" to "), F.date_format(F.date_add(d(), 6), "dd/MM/yyyy"))}, {"span": f"strftime(o_orderdate, '%d/%m') || ' to ' || strftime({OD} + 6, '%d/%m/%Y')"})

# --- maths -------------------------------------------------------------------------------------------------------

L, LK = "lineitem", "l_orderkey, l_linenumber"
R = lambda s: f"round({s} + 1e-9, 6)"
q, p = lambda: col("l_quantity"), lambda: col("l_discount") * 8 + 0.05
P = "(l_discount * 8 + 0.05)"
project("mth_1_grid_snap", L, LK, {"cell": lambda: M.grid_key(col("l_quantity") / 4, 1.0)}, {"cell": "round_even(l_quantity / 4, 0)::BIGINT"})
project("mth_2_logit_sigmoid", L, LK, {"l1p": lambda: M.r6(F.log1p(q())), "lg": lambda: M.r6(M.logit(p())), "sg": lambda: M.r6(M.sigmoid(q() / 10 - 2))}, {"l1p": R("ln(1 + l_quantity)"), "lg": R(f"ln({P} / (1 - {P}))"), "sg": R("1 / (1 + exp(-(l_quantity / 10 - 2)))")})
project("mth_3_decay", L, LK, {"w": lambda: M.r6(M.decay(q()))}, {"w": R("pow(10, -l_quantity / 30)")})
project("mth_4_dilution", L, LK, {"w": lambda: M.r6(M.dilution(col("l_extendedprice"), col("l_extendedprice") * 3))}, {"w": R("least(1.0, (l_extendedprice + 5000) / (l_extendedprice * 3 + 5000))")})
project("mth_5_velocity", L, LK, {"v": lambda: M.r6(M.velocity(F.when(col("l_linenumber") != 3, q() / 30)))}, {"v": R("CASE WHEN l_linenumber = 3 THEN 0.5 ELSE 0.3 + 0.7 * least(greatest(l_quantity / 30, 0), 1.5) END")})
project("mth_6_recency", L, LK, {"w": lambda: M.r6(M.recency(col("l_returnflag") == "R", q() + 10))}, {"w": R("CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_quantity + 10 BETWEEN 0 AND 48 THEN 1 - (l_quantity + 10) / 48 ELSE 0.0 END")})
project("mth_7_risk_label", L, LK, {"label": lambda: M.risk_label(p())}, {"label": f"CASE WHEN {P} < 0.15 THEN 'low' WHEN {P} < 0.4 THEN 'moderate' WHEN {P} < 0.7 THEN 'high' ELSE 'very high' END"})
project("mth_8_level_index", L, LK, {"idx": lambda: M.r6(M.level_index(q(), lit(5.0), col("l_tax") * 500)), "word": lambda: M.level_word(M.level_index(q(), lit(5.0), col("l_tax") * 500))}, {"idx": R("CASE WHEN l_tax * 500 > 5 THEN (l_quantity - 5) / (l_tax * 500 - 5) END"), "word": "CASE WHEN NOT (l_tax * 500 > 5) THEN NULL WHEN (l_quantity - 5) / (l_tax * 500 - 5) < 0.15 THEN 'low' WHEN (l_quantity - 5) / (l_tax * 500 - 5) < 0.6 THEN 'normal' WHEN (l_quantity - 5) / (l_tax * 500 - 5) <= 1.0 THEN 'raised' ELSE 'high' END"})
project("mth_9_flow_word", L, LK, {"flow": lambda: F.when(q() / 40 > 1, "high").when(col("l_tax") > 0.05, "rising").otherwise("steady")}, {"flow": "CASE WHEN l_quantity / 40 > 1 THEN 'high' WHEN l_tax > 0.05 THEN 'rising' ELSE 'steady' END"})
project("mth_10_interpolate", L, LK, {"cal": lambda: M.r6(M.interpolate(p(), [0.1, 0.3, 0.6], [0.05, 0.2, 0.8]))}, {"cal": R(f"CASE WHEN {P} <= 0.1 THEN 0.05 WHEN {P} <= 0.3 THEN 0.05 + ({P} - 0.1) * ((0.2 - 0.05) / (0.3 - 0.1)) WHEN {P} <= 0.6 THEN 0.2 + ({P} - 0.3) * ((0.8 - 0.2) / (0.6 - 0.3)) ELSE 0.8 END")})
project("mth_11_lead_clamp", L, LK, {"cal_lead": lambda: big(F.least(F.greatest(col("l_linenumber") - 2, lit(0)), lit(3)))}, {"cal_lead": "least(greatest(l_linenumber - 2, 0), 3)::BIGINT"})
project("mth_12_great_circle", "supplier", "s_suppkey", {"km": lambda: M.r6(M.haversine_km(lit(52.0), lit(-1.0), 50 + col("s_suppkey") % 90 / lit(10.0), -6 + col("s_suppkey") % 70 / lit(10.0)))}, {"km": R("12742.0 * asin(sqrt(pow(sin(radians(50 + s_suppkey % 90 / 10.0 - 52.0) / 2), 2) + cos(radians(52.0)) * cos(radians(50 + s_suppkey % 90 / 10.0)) * pow(sin(radians(-6 + s_suppkey % 70 / 10.0 + 1.0) / 2), 2)))")})
project("mth_13_bands", L, LK, {"band": lambda: F.when(q() < 1, "0-1").when(q() < 10, "1-10").when(q() < 25, "10-25").otherwise("25+")}, {"band": "CASE WHEN l_quantity < 1 THEN '0-1' WHEN l_quantity < 10 THEN '1-10' WHEN l_quantity < 25 THEN '10-25' ELSE '25+' END"})
project("mth_14_climatology", "customer", "c_custkey", {"clim": lambda: M.r6(M.clip(F.coalesce(F.when(col("c_acctbal") >= 0, col("c_acctbal") / 50), lit(20.0)) * 1.004 / 365, 0.001, 0.95))}, {"clim": R("least(greatest(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 50 END, 20.0) * 1.004 / 365, 0.001), 0.95)")})
project("mth_15_fallback", "customer", "c_custkey", {"p": lambda: M.r6(F.coalesce(F.when(col("c_acctbal") >= 0, M.clip(col("c_acctbal") / 10000, 0.001, 0.95)), lit(0.05)))}, {"p": R("coalesce(CASE WHEN c_acctbal >= 0 THEN least(greatest(c_acctbal / 10000, 0.001), 0.95) END, 0.05)")})
project("mth_16_grid_letters", "supplier", "s_suppkey", {"east": lambda: big((F.ascii(F.substring("s_name", 1, 1)) - 65) * 100000 + col("s_suppkey") % 1000)}, {"east": "((ascii(s_name[1]) - 65) * 100000 + s_suppkey % 1000)::BIGINT"})
project("mth_18_local_frame", "supplier", "s_suppkey", {"dx": lambda: M.r6((col("s_suppkey") % 70 / lit(10.0)) * 111320 * F.cos(F.radians(lit(52.0)))), "dy": lambda: M.r6((col("s_suppkey") % 90 / lit(10.0)) * 110540.0)}, {"dx": R("(s_suppkey % 70 / 10.0) * 111320 * cos(radians(52.0))"), "dy": R("(s_suppkey % 90 / 10.0) * 110540.0")})
query("mth_19_quantiles", "SELECT o_orderpriority, " + R("quantile_cont(o_totalprice, 0.025)") + " AS lo, " + R("quantile_cont(o_totalprice, 0.975)") + " AS hi FROM orders GROUP BY o_orderpriority")(lambda t: t.orders.groupBy("o_orderpriority").agg(M.r6(F.percentile("o_totalprice", 0.025)).alias("lo"), M.r6(F.percentile("o_totalprice", 0.975)).alias("hi")))

# --- arrays ------------------------------------------------------------------------------------------------------

project("arr_2_repeat_explode", "supplier", "s_suppkey", {"k": lambda: F.explode(F.sequence(lit(0).cast("bigint"), col("s_suppkey") % 4))}, {"k": "unnest(generate_series(0, s_suppkey % 4))::BIGINT"})
query("arr_1_bits", "SELECT user_id, ts::DATE AS day, bit_or(1::BIGINT << (hour(ts) * 2 + minute(ts) // 30)::INT) AS slots, bit_count(bit_or(1::BIGINT << (hour(ts) * 2 + minute(ts) // 30)::INT))::BIGINT AS n FROM events GROUP BY user_id, ts::DATE")(
    lambda t: t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bit_or(F.call_function("shiftleft", lit(1).cast("bigint"), D.slot(col("ts")))).alias("slots")).withColumn("n", big(F.bit_count("slots")))
)
query("arr_3_max_gap", "SELECT user_id, max(s - p)::BIGINT AS gap FROM (SELECT user_id, hour(ts) AS s, lag(hour(ts)) OVER (PARTITION BY user_id, ts::DATE ORDER BY hour(ts), event_id) AS p FROM events) GROUP BY user_id HAVING max(s - p) IS NOT NULL")(
    lambda t: t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.hour("ts"))).alias("h")).select("user_id", F.array_max(F.zip_with(F.slice("h", lit(2), F.size("h") - 1), F.slice("h", lit(1), F.size("h") - 1), lambda b, a: b - a)).alias("g")).groupBy("user_id").agg(big(F.max("g")).alias("gap")).filter("gap IS NOT NULL")
)
query("arr_4_delta_code", "SELECT l_suppkey, array_to_string(list_transform(range(1, len(x) + 1), lambda i: x[i] - coalesce(x[i - 1], 0)), ',') AS deltas FROM (SELECT l_suppkey, list_sort(list_distinct(list(l_partkey))) AS x FROM lineitem GROUP BY l_suppkey)")(
    lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("x")).select("l_suppkey", F.array_join(F.transform("x", lambda v, i: (v - F.coalesce(F.get(col("x"), i - 1), lit(0))).cast("string")), ",").alias("deltas"))
)
project("arr_5_word_overlap", "part", "p_partkey", {"shared": lambda: big(F.size(F.array_intersect(F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", lit("hot"), "p_type")), " "))))}, {"shared": "len(list_intersect(string_split(lower(p_name), ' '), string_split(lower('hot ' || p_type), ' ')))::BIGINT"})
project("arr_6_element_max", "lineitem", LK, {"rel": lambda: M.r6(F.greatest(col("l_tax"), col("l_discount") * 0.8, col("l_quantity") / 500))}, {"rel": R("greatest(l_tax, l_discount * 0.8, l_quantity / 500)")})
project("arr_7_map_default", "orders", "o_orderkey", {"rank": lambda: big(F.coalesce(F.try_element_at(F.create_map(lit("F"), lit(0), lit("O"), lit(1)), col("o_orderstatus")), lit(9)))}, {"rank": "coalesce(map {'F': 0, 'O': 1}[o_orderstatus], 9)::BIGINT"})
project("arr_8_json_field", "events", "event_id", {"k": lambda: F.coalesce(F.get_json_object("props", "$.k._value"), F.get_json_object("props", "$.k")).try_cast("bigint")}, {"k": "try_cast(coalesce(json_extract_string(props, '$.k._value'), json_extract_string(props, '$.k')) AS BIGINT)"})
project("arr_9_json_array", "events", "event_id", {"total": lambda: F.aggregate(F.from_json(F.concat(lit("["), F.get_json_object("props", "$.k"), lit(",2,3]")), "array<bigint>"), lit(0).cast("bigint"), lambda a, x: a + x)}, {"total": "list_sum(from_json('[' || json_extract_string(props, '$.k') || ',2,3]', '[\"BIGINT\"]'))::BIGINT"})
project("arr_10_json_build", "customer", "c_custkey", {"doc": lambda: F.to_json(F.struct(col("c_custkey").alias("id"), F.struct(col("c_nationkey").alias("nation")).alias("site")))}, {"doc": "'{\"id\":' || c_custkey || ',\"site\":{\"nation\":' || c_nationkey || '}}'"})
query("arr_11_bounds", "SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")))
query("arr_12_tiles_of_box", "SELECT s_suppkey, r::BIGINT AS tile_row, c::BIGINT AS tile_col FROM supplier, unnest(generate_series(s_suppkey % 7, s_suppkey % 7 + 2)) u(r), unnest(generate_series(s_suppkey % 5, s_suppkey % 5 + s_suppkey % 2)) v(c)")(
    lambda t: t.supplier.select("s_suppkey", F.explode(F.sequence(col("s_suppkey") % 7, col("s_suppkey") % 7 + 2)).alias("tile_row")).select("s_suppkey", "tile_row", F.explode(F.sequence(col("s_suppkey") % 5, col("s_suppkey") % 5 + col("s_suppkey") % 2)).alias("tile_col"))
)
