"""Dashboards, sorts, joins/sets, sinks-as-joins, decision rules (AGG, SRT, JON, SET, SNK-04/05, SCR)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.constants import (
    CAUSE_DISPLAY, CONGESTION_CAUSE_WEIGHT, FALLBACK_RULES, POLICE_STATIONS, REPORT_CATEGORY_CAUSE,
    RESOURCES, TRIAGE, WEATHER_CODES, WEATHER_STATES,
)
from roadlens.functions.common import first_match
from roadlens.functions.text import cause_display, report_cause
from roadlens.operators import dashboards as dash
from roadlens.operators import joins, rolling, score
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.hotspots import nearest_junction_planar
from roadlens.plans.q_core import REPORT_CATEGORIES, _planar_sql
from roadlens.sources.tables import cameras, incidents, pick, read_table

D = O.d


# ------------------------------------------------------------------ shared base: scored incidents

def dash_base(spark, sf) -> DataFrame:
    """Incidents + rule probability (SCR-04), tier (SCR-02), nearest named junction (GEO-05):
    a pure projection of the scan, pruned to the columns a query reads."""
    inc = incidents(spark, sf).select(
        "id", "ts", "event_cause", "event_type", F.coalesce("zone", F.lit("unknown_zone")).alias("zone"), "corridor",
        "police_station", "status", "priority", "requires_road_closure", "duration_mins", "num_lanes", "latitude",
        "longitude", "description")
    prob = score.fallback_probability("event_cause", "num_lanes", "duration_mins")
    name, dist = nearest_junction_planar()
    b = inc.select("*", prob.alias("prob"), name.alias("nearest_junction"), dist.alias("nearest_junction_dist_km"))
    return b.select("*", score.risk_tier("prob").alias("risk_level"))


def with_density(b: DataFrame) -> DataFrame:
    """``b`` + 3 h density (ROL-01 over all incidents) and congestion score (SCR-05): only for
    queries that read them, since the range count is the expensive part."""
    b = rolling.window_counts(b, b.select("id", "ts"), 3, out="roll")
    return b.select("*", score.congestion_score("duration_mins", "num_lanes", "event_cause", "roll", "prob").alias("score"))


def dash_scored(spark, sf) -> DataFrame:
    return with_density(dash_base(spark, sf))


def _prob_sql():
    lc = "lower(coalesce(CAST(event_cause AS VARCHAR), 'none'))"
    whens = " ".join(f"WHEN {O.contains_any(lc, ws)} THEN {D(p)}" for ws, p in FALLBACK_RULES)
    base = f"(CASE {whens} ELSE {D(0.15)} END)"
    return (f"least(greatest({base} + CASE WHEN coalesce(num_lanes, 1) > 2 THEN {D(0.10)} ELSE {D(0.0)} END "
            f"+ CASE WHEN coalesce(duration_mins, 30.0) > 60 THEN {D(0.05)} ELSE {D(0.0)} END, {D(0.05)}), {D(0.95)})")


_TIER = f"CASE WHEN prob >= {D(0.70)} THEN 'CRITICAL' WHEN prob >= {D(0.50)} THEN 'HIGH' WHEN prob >= {D(0.35)} THEN 'MEDIUM' ELSE 'LOW' END"
_SCORE = (f"least(least(duration_mins / {D(120.0)}, {D(1.0)}) * {D(20.0)} + least(num_lanes / {D(4.0)}, {D(1.0)}) * {D(20.0)} "
          f"+ {O.dmap('lower(event_cause)', CONGESTION_CAUSE_WEIGHT, 10.0)} + least(roll / {D(10.0)}, {D(1.0)}) * {D(15.0)} "
          f"+ prob * {D(20.0)}, {D(100.0)})")

DASH_CTE = f"""
SELECT id, ts, event_cause, event_type, zone, corridor, police_station, status, priority, requires_road_closure,
       duration_mins, num_lanes, latitude, longitude, description, roll, prob,
       CASE WHEN nj.d < 999.0 THEN nj.n ELSE 'City Centre' END AS nearest_junction,
       least(nj.d, 999.0) AS nearest_junction_dist_km, {_TIER} AS risk_level, {_SCORE} AS score
FROM (SELECT i.* REPLACE (coalesce(zone, 'unknown_zone') AS zone),
             CASE WHEN i.ts IS NULL THEN 0 ELSE (SELECT count(*) FROM incidents t WHERE t.ts IS NOT NULL
                  AND epoch_us(t.ts) >= epoch_us(i.ts) - {3 * 3600 * 1000000} AND epoch_us(t.ts) < epoch_us(i.ts)) END AS roll,
             {_prob_sql()} AS prob, {_planar_sql()} AS nj
      FROM incidents i)"""


def with_dash(body: str, **ctes) -> str:
    return O.with_ctes(body, d=DASH_CTE, **ctes)


# ------------------------------------------------------------------ aggregates (AGG)

def _tier(c):
    return f"CASE WHEN {c} >= 75 THEN 'CRITICAL' WHEN {c} >= 55 THEN 'HIGH' WHEN {c} >= 35 THEN 'MEDIUM' ELSE 'LOW' END"


def tier75(c):
    return first_match([(F.col(c) >= 75, "CRITICAL"), (F.col(c) >= 55, "HIGH"), (F.col(c) >= 35, "MEDIUM")], "LOW")


@register("agg_01", with_dash(
    f"SELECT zone, active_events, round(avg_score, 6) AS avg_congestion_score, {_tier('avg_score')} AS risk_level FROM "
    "(SELECT zone, count(*) FILTER (WHERE status <> 'RESOLVED') AS active_events, avg(score) AS avg_score FROM d GROUP BY zone)"))
def agg_01(spark, sf):
    return dash.zone_congestion(dash_scored(spark, sf)).select(
        "zone", "active_events", F.round("avg_score", 6).alias("avg_congestion_score"), tier75("avg_score").alias("risk_level"))


@register("agg_02", with_dash(
    "SELECT round(avg(avg_score), 6) AS network_congestion_score, CAST(sum(active_events) AS BIGINT) AS active_incidents, "
    "CASE WHEN avg(avg_score) >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS network_risk_level FROM "
    "(SELECT zone, count(*) FILTER (WHERE status <> 'RESOLVED') AS active_events, avg(score) AS avg_score FROM d GROUP BY zone)"))
def agg_02(spark, sf):
    return dash.network_summary(dash.zone_congestion(dash_scored(spark, sf)))


@register("agg_03", with_dash(
    f"SELECT nearest_junction AS name, round(s, 6) AS congestion_score, {_tier('s')} AS risk_level, n AS incident_count, "
    "round(s * 0.45, 6) AS avg_delay_mins FROM (SELECT nearest_junction, avg(score) AS s, count(*) AS n FROM d "
    "GROUP BY nearest_junction)"))
def agg_03(spark, sf):
    return dash.junction_table(dash_scored(spark, sf))


@register("agg_04", O.with_ctes(
    "SELECT b.h AS hour_bin, coalesce(c.n, 0) AS incidents, "
    "CAST(greatest(10, least(round_even(coalesce(c.n, 0) / (SELECT count(*) FROM incidents WHERE ts IS NOT NULL) * 100 * 6.5, 0), 98)) AS BIGINT) "
    "AS congestion_pct FROM (SELECT unnest(range(0, 24, 2)) AS h) b LEFT JOIN "
    "(SELECT CAST(floor(hour(ts) / 2) * 2 AS BIGINT) AS h, count(*) AS n FROM incidents WHERE ts IS NOT NULL GROUP BY 1) c "
    "ON b.h = c.h"))
def agg_04(spark, sf):
    return dash.two_hour_bins(incidents(spark, sf).select("ts"))


@register("agg_05", O.with_ctes(
    f"SELECT cause, count, round_even(count / sum(count) OVER () * 100, 2) AS percentage FROM "
    f"(SELECT {O.dmap('event_cause', CAUSE_DISPLAY, 'Others')} "
    "AS cause, count(*) AS count FROM incidents GROUP BY 1)"))
def agg_05(spark, sf):
    df = incidents(spark, sf).select(cause_display("event_cause").alias("cause"))
    return dash.distribution(df, "cause")


@register("agg_06", with_dash("""
SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'RESOLVED') AS open,
       count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
       count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high,
       count(*) FILTER (WHERE risk_level = 'CRITICAL' AND status <> 'RESOLVED') AS critical_active,
       count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'DISPATCHED') AS dispatched,
       count(*) FILTER (WHERE status = 'ON_SCENE') AS on_scene,
       count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM d)) AS today FROM d"""))
def agg_06(spark, sf):
    return dash.kpi_counts(dash_base(spark, sf))


@register("agg_07", O.with_ctes(
    "SELECT event_cause, corridor, n, rk FROM (SELECT event_cause, corridor, n, row_number() OVER "
    "(PARTITION BY event_cause ORDER BY n DESC, corridor) AS rk FROM (SELECT event_cause, corridor, count(*) AS n "
    "FROM incidents WHERE corridor IS NOT NULL GROUP BY ALL)) WHERE rk <= 5"))
def agg_07(spark, sf):
    return dash.top_k_per_group(incidents(spark, sf).select("event_cause", "corridor"), "event_cause", "corridor", 5)


@register("agg_08", O.with_ctes(
    "SELECT police_station, count(*) AS n FROM incidents GROUP BY 1 ORDER BY n DESC, police_station LIMIT 10"))
def agg_08(spark, sf):
    return dash.top_n(incidents(spark, sf).select("police_station"), "police_station", 10)


def _cameras_sql():
    return f"""
SELECT camera_id, status, density, queue_length_m, vehicle_count, uptime_pct, incident, ts, event_id FROM (
  SELECT (user_id % 6) + 1 AS camera_id, ts, event_id,
         CASE WHEN event_type = 'error' AND value > 200 THEN 'OFFLINE' ELSE 'ONLINE' END AS status,
         CASE WHEN value > 300 THEN 'JAMMED' WHEN value > 150 THEN 'HEAVY' WHEN value > 60 THEN 'MODERATE' ELSE 'LOW' END AS density,
         value * {D(2.0)} AS queue_length_m, CAST(floor(value * 3) AS INTEGER) AS vehicle_count,
         {D(100.0)} - CAST(event_id % 50 AS DOUBLE) / {D(10.0)} AS uptime_pct,
         CASE WHEN value > 250 THEN 'Congestion' ELSE 'None' END AS incident
  FROM events)"""


@register("agg_09", O.with_ctes("""
SELECT round(avg(uptime_pct) FILTER (WHERE status = 'ONLINE'), 6) AS avg_uptime,
       round(avg(queue_length_m) FILTER (WHERE status = 'ONLINE'), 6) AS avg_queue,
       CAST(sum(vehicle_count) AS BIGINT) AS total_vehicles, arg_max(camera_id, (queue_length_m, -camera_id)) AS worst_camera,
       count(*) FILTER (WHERE incident <> 'None') AS incident_cameras
FROM (SELECT camera_id, arg_max(status, (ts, event_id)) AS status, arg_max(uptime_pct, (ts, event_id)) AS uptime_pct,
             arg_max(queue_length_m, (ts, event_id)) AS queue_length_m, arg_max(vehicle_count, (ts, event_id)) AS vehicle_count,
             arg_max(incident, (ts, event_id)) AS incident FROM cam GROUP BY camera_id)""", cam=_cameras_sql()))
def agg_09(spark, sf):
    return dash.camera_fleet(dash.latest_per_camera(cameras(spark, sf)))


@register("agg_10", O.with_ctes(
    "SELECT event_cause, count(*) AS n, avg(CAST(requires_road_closure AS DOUBLE)) AS closure_rate, "
    "avg(CASE WHEN priority = 'High' THEN 1.0 ELSE 0.0 END) AS high_priority_rate FROM incidents GROUP BY 1"))
def agg_10(spark, sf):
    return dash.cause_crosstab(incidents(spark, sf).select("event_cause", "requires_road_closure", "priority"))


_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


@register("agg_11", with_dash(f"""
SELECT metric, round(before, 6) AS before, round(after, 6) AS after,
       round((after - before) / before * 100, 6) AS pct_change FROM (
  SELECT 'incidents' AS metric, CAST(count(*) FILTER (WHERE ts < {_SPLIT}) AS DOUBLE) AS before,
         CAST(count(*) FILTER (WHERE ts >= {_SPLIT}) AS DOUBLE) AS after FROM d
  UNION ALL SELECT 'avg_congestion_score', avg(score) FILTER (WHERE ts < {_SPLIT}), avg(score) FILTER (WHERE ts >= {_SPLIT}) FROM d
  UNION ALL SELECT 'avg_duration_mins', avg(duration_mins) FILTER (WHERE ts < {_SPLIT}),
         avg(duration_mins) FILTER (WHERE ts >= {_SPLIT}) FROM d
  UNION ALL SELECT 'closure_rate', avg(CAST(requires_road_closure AS DOUBLE)) FILTER (WHERE ts < {_SPLIT}),
         avg(CAST(requires_road_closure AS DOUBLE)) FILTER (WHERE ts >= {_SPLIT}) FROM d)"""))
def agg_11(spark, sf):
    return dash.before_after(dash_scored(spark, sf), "2024-01-16 00:00:00")


@register("agg_12", with_dash(
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS incidents, round(avg(score), 6) AS avg_score, "
    "count(*) FILTER (WHERE requires_road_closure = 1) AS closures FROM d WHERE ts IS NOT NULL GROUP BY 1"))
def agg_12(spark, sf):
    return dash.weekly_trend(dash_scored(spark, sf))


@register("agg_13", with_dash("""
SELECT hour(ts) AS hour, round(avg(score) FILTER (WHERE CAST(ts AS DATE) = ld), 6) AS live_score,
       round(avg(score) FILTER (WHERE CAST(ts AS DATE) <> ld), 6) AS baseline_score,
       round(avg(score * 0.45) FILTER (WHERE CAST(ts AS DATE) = ld), 6) AS live_delay,
       round(avg(score * 0.45) FILTER (WHERE CAST(ts AS DATE) <> ld), 6) AS baseline_delay
FROM d, (SELECT max(CAST(ts AS DATE)) AS ld FROM d) m WHERE ts IS NOT NULL GROUP BY 1"""))
def agg_13(spark, sf):
    return dash.live_vs_baseline(dash_scored(spark, sf))


@register("agg_14", with_dash("""
SELECT isodow(ts) - 1 AS day_of_week,
       round(count(*) / (SELECT count(DISTINCT date_trunc('week', ts)) FROM d WHERE ts IS NOT NULL), 6) AS typical,
       count(*) FILTER (WHERE ts > mx - INTERVAL 7 DAY) AS active,
       count(*) FILTER (WHERE ts > mx - INTERVAL 7 DAY AND risk_level = 'CRITICAL') AS alerts
FROM d, (SELECT max(ts) AS mx FROM d) m WHERE ts IS NOT NULL GROUP BY 1"""))
def agg_14(spark, sf):
    return dash.weekday_profile(dash_base(spark, sf))


@register("agg_15", with_dash(f"""
SELECT rain_bin, count(*) AS n, round(avg(score * 0.45), 6) AS avg_delay, round(avg(least(rain_mm * 2.0, 40.0)), 6) AS speed_drop_pct,
       round((SELECT corr(w.rain_mm, d2.score * 0.45) FROM d d2 JOIN w ON date_trunc('hour', d2.ts) = w.hr), 6) AS rain_delay_corr
FROM (SELECT d.score, w.rain_mm, CASE WHEN w.rain_mm = 0 THEN '0' WHEN w.rain_mm <= 2 THEN '0-2' WHEN w.rain_mm <= 10 THEN '2-10'
             ELSE '>10' END AS rain_bin FROM d JOIN w ON date_trunc('hour', d.ts) = w.hr) GROUP BY 1""",
    w=f"SELECT date_trunc('hour', ts) AS hr, avg(CASE WHEN value > 100 THEN value / {D(20.0)} ELSE {D(0.0)} END) AS rain_mm "
      "FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY 1"))
def agg_15(spark, sf):
    from roadlens.sources.tables import hourly_weather
    return dash.rain_impact(dash_scored(spark, sf), hourly_weather(spark, sf))


# ------------------------------------------------------------------ sorts (SRT)

@register("srt_01", with_dash(
    "SELECT id, status, risk_level, row_number() OVER (PARTITION BY status ORDER BY "
    "CASE risk_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, "
    "ts DESC NULLS LAST, id) - 1 AS queue_pos FROM d WHERE status <> 'RESOLVED'"))
def srt_01(spark, sf):
    return dash.priority_queue(dash_base(spark, sf))


@register("srt_02", with_dash("""
SELECT * FROM (SELECT 'top_zones' AS list, zone AS item, round(avg(score), 6) AS value FROM d GROUP BY zone
               ORDER BY value DESC, item LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'recent' AS list, CAST(id AS VARCHAR) AS item, CAST(epoch_us(ts) AS DOUBLE) AS value FROM d
               WHERE status <> 'RESOLVED' AND ts IS NOT NULL ORDER BY ts DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'alerts' AS list, CAST(id AS VARCHAR) AS item, round(prob, 6) AS value FROM d
               WHERE risk_level = 'CRITICAL' AND status <> 'RESOLVED' ORDER BY prob DESC, ts DESC NULLS LAST, id LIMIT 3)"""))
def srt_02(spark, sf):
    return dash.top_lists(dash_scored(spark, sf))


@register("srt_03", with_dash("""
SELECT id, kind, epoch_us(ts) + off * 1000000 AS log_us FROM d,
  (SELECT * FROM (VALUES ('reported', 0, 0), ('dispatch', 30, 1), ('scene', 180, 2), ('resolved', 600, 3)) t(kind, off, lvl)) l
WHERE ts IS NOT NULL AND lvl <= CASE status WHEN 'PENDING' THEN 0 WHEN 'DISPATCHED' THEN 1 WHEN 'ON_SCENE' THEN 2 ELSE 3 END
ORDER BY log_us DESC, id, kind LIMIT 30"""))
def srt_03(spark, sf):
    return dash.lifecycle_log(dash_base(spark, sf), 30)


# ------------------------------------------------------------------ joins / sets (JON, SET, SNK-04/05)

@register("jon_01", "SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'UNKNOWN') AS segment, coalesce(c.c_acctbal, 0.0) AS acctbal "
                    "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def jon_01(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("segment"),
                                                 F.col("c_acctbal").alias("acctbal"))
    return joins.lookup_with_default(o, c, {"o_custkey": "c_custkey"}, {"segment": "UNKNOWN", "acctbal": 0.0}).drop("o_custkey")


@register("jon_02", "SELECT c.c_custkey, coalesce(s.n_orders, 0) AS n_orders, coalesce(s.total, 0.0) AS total "
                    "FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 6) AS total "
                    "FROM orders GROUP BY 1) s ON c.c_custkey = s.o_custkey")
def jon_02(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey")
    o = read_table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"),
                                                             F.round(F.sum("o_totalprice"), 6).alias("total"))
    return joins.left_fill(c, s, ["c_custkey"], {"n_orders": 0, "total": 0.0})


@register("jon_03", "SELECT coalesce(a.k, b.k) AS custkey, a.n_orders, b.acctbal FROM "
                    "(SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) a FULL OUTER JOIN "
                    "(SELECT c_custkey AS k, c_acctbal AS acctbal FROM customer) b ON a.k = b.k")
def jon_03(spark, sf):
    a = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    return joins.full_merge(a, b, ["custkey"])


@register("jon_04", O.with_ctes(
    "SELECT id, status FROM incidents WHERE id NOT IN (SELECT id FROM incidents WHERE id % 10 = 0) "
    "UNION ALL SELECT id, 'RESOLVED' AS status FROM incidents WHERE id % 10 = 0"))
def jon_04(spark, sf):
    cached = incidents(spark, sf).select("id", "status")
    live = cached.filter(F.col("id") % 10 == 0).select("id", F.lit("RESOLVED").alias("status"))
    return joins.upsert_union(cached, live, ["id"])


@register("jon_05", "SELECT 'customers_with_orders' AS kind, count(*) AS n FROM customer WHERE c_custkey IN "
                    "(SELECT o_custkey FROM orders) UNION ALL SELECT 'shared_nations', count(*) FROM "
                    "(SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def jon_05(spark, sf):
    c = read_table(spark, sf, "customer")
    o = read_table(spark, sf, "orders")
    s = read_table(spark, sf, "supplier")
    semi = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").agg(F.count(F.lit(1)).alias("n"))
    inter = c.select(F.col("c_nationkey").alias("k")).intersect(s.select(F.col("s_nationkey").alias("k"))) \
        .agg(F.count(F.lit(1)).alias("n"))
    return semi.select(F.lit("customers_with_orders").alias("kind"), "n").unionByName(
        inter.select(F.lit("shared_nations").alias("kind"), "n"))


@register("jon_06", with_dash(
    "SELECT ns AS station, arg_min(id, (ts, id)) AS first_incident, min(ts) AS first_ts FROM "
    "(SELECT id, ts, s.n AS ns FROM (SELECT *, " + "list_min([" + ", ".join(
        f"{{'d': round_even({D(6371.0)} * (2 * atan2(sqrt(a{i}), sqrt(1 - a{i}))), 2), 'i': {i}, 'n': {O.q(n)}}}"
        for i, (n, _, _) in enumerate(POLICE_STATIONS))
    + "]) AS s FROM (SELECT *, " + ", ".join(
        f"(pow(sin(radians({D(la)} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({D(la)})) * "
        f"pow(sin(radians({D(lo)} - longitude) / 2), 2)) AS a{i}"
        for i, (_, la, lo) in enumerate(POLICE_STATIONS))
    + " FROM d WHERE risk_level IN ('HIGH', 'CRITICAL') AND status <> 'RESOLVED' AND ts IS NOT NULL))) GROUP BY 1"))
def jon_06(spark, sf):
    b = dash_base(spark, sf)
    return joins.first_match_per_place(b)


_RES_NAMES = [r[0] for r in RESOURCES]


@register("jon_07", O.with_ctes(
    "SELECT r.name, r.type, CASE WHEN a.n_dispatched > 0 THEN 'EN_ROUTE' WHEN a.n_scene > 0 THEN 'ON_SCENE' "
    "ELSE 'AVAILABLE' END AS team_status, coalesce(a.n_active, 0) AS active_assignments FROM (VALUES "
    + ", ".join(f"({O.q(n)}, {O.q(t)})" for n, t, _ in RESOURCES) + ") r(name, type) LEFT JOIN "
    f"(SELECT {O.case_pick('id % 8', _RES_NAMES)} AS name, count(*) AS n_active, "
    "count(*) FILTER (WHERE status = 'DISPATCHED') AS n_dispatched, count(*) FILTER (WHERE status = 'ON_SCENE') AS n_scene "
    "FROM incidents WHERE status IN ('DISPATCHED', 'ON_SCENE') GROUP BY 1) a ON r.name = a.name"))
def jon_07(spark, sf):
    inc = incidents(spark, sf).select("id", "status", pick(F.col("id") % 8, _RES_NAMES).alias("assigned_resource"))
    return joins.team_availability(spark, inc)


@register("set_01", O.with_ctes(
    "SELECT 'train_only' AS kind, corridor FROM (SELECT corridor FROM incidents WHERE is_train AND corridor IS NOT NULL "
    "EXCEPT SELECT corridor FROM incidents WHERE NOT is_train AND requires_road_closure = 1) UNION ALL "
    "SELECT 'either' AS kind, corridor FROM (SELECT corridor FROM incidents WHERE requires_road_closure = 1 AND "
    "corridor IS NOT NULL UNION SELECT corridor FROM incidents WHERE priority = 'High' AND event_cause = 'accident' "
    "AND corridor IS NOT NULL)"))
def set_01(spark, sf):
    inc = incidents(spark, sf).select("corridor", "is_train", "requires_road_closure", "priority", "event_cause") \
        .filter(F.col("corridor").isNotNull())
    a = inc.filter("is_train").select("corridor").subtract(
        inc.filter(~F.col("is_train") & (F.col("requires_road_closure") == 1)).select("corridor"))
    b = inc.filter(F.col("requires_road_closure") == 1).select("corridor").union(
        inc.filter((F.col("priority") == "High") & (F.col("event_cause") == "accident")).select("corridor")).distinct()
    return a.select(F.lit("train_only").alias("kind"), "corridor").unionByName(b.select(F.lit("either").alias("kind"), "corridor"))


@register("snk_04", O.with_ctes(
    "SELECT id, status FROM incidents WHERE id % 3 = 0 UNION ALL SELECT id, status FROM incidents "
    "WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM incidents WHERE id % 3 = 0)"))
def snk_04(spark, sf):
    inc = incidents(spark, sf).select("id", "status")
    return joins.insert_if_absent(inc.filter(F.col("id") % 3 == 0), inc.filter(F.col("id") % 2 == 0), ["id"])


_UPD = "SELECT id, 'RESOLVED' AS new_status FROM incidents WHERE id % 7 = 0 UNION ALL SELECT id + 1000000000, 'RESOLVED' FROM incidents WHERE id % 701 = 0"


@register("snk_05", O.with_ctes(
    "SELECT i.id, coalesce(u.new_status, i.status) AS status, u.id IS NOT NULL AS updated FROM incidents i "
    "LEFT JOIN u ON i.id = u.id", u=_UPD))
def snk_05(spark, sf):
    inc = incidents(spark, sf).select("id", "status")
    upd = joins.status_updates(inc)
    return joins.merge_updates(inc, upd, "id")[0]


@register("snk_05_unmatched", O.with_ctes("SELECT u.id FROM u WHERE u.id NOT IN (SELECT id FROM incidents)", u=_UPD))
def snk_05_unmatched(spark, sf):
    inc = incidents(spark, sf).select("id", "status")
    return joins.merge_updates(inc, joins.status_updates(inc), "id")[1]


# ------------------------------------------------------------------ decision rules (SCR)

@register("scr_02", with_dash("SELECT id, round(prob, 6) AS prob, risk_level FROM d"))
def scr_02(spark, sf):
    return dash_base(spark, sf).select("id", F.round("prob", 6).alias("prob"), "risk_level")


@register("scr_03", with_dash(
    f"SELECT id, CASE WHEN abs(prob - {D(0.5)}) / {D(0.5)} >= {D(0.8)} THEN 'High' WHEN abs(prob - {D(0.5)}) / {D(0.5)} "
    f">= {D(0.6)} THEN 'Medium' ELSE 'Low' END AS confidence, CAST(prob >= {D(0.35)} AS INTEGER) AS predicted_label FROM d"))
def scr_03(spark, sf):
    b = dash_base(spark, sf)
    return b.select("id", score.confidence_tier("prob").alias("confidence"), score.decision("prob").alias("predicted_label"))


@register("scr_04", O.with_ctes(f"SELECT id, round({_prob_sql()}, 6) AS probability_closure FROM incidents"))
def scr_04(spark, sf):
    inc = incidents(spark, sf)
    return inc.select("id", F.round(score.fallback_probability("event_cause", "num_lanes", "duration_mins"), 6)
                      .alias("probability_closure"))


@register("scr_05", with_dash("SELECT id, roll AS rolling_3h_count, round(score, 6) AS congestion_score FROM d"))
def scr_05(spark, sf):
    return dash_scored(spark, sf).select("id", F.col("roll").alias("rolling_3h_count"), F.round("score", 6).alias("congestion_score"))


@register("scr_06", with_dash(
    "SELECT id, CAST(prob >= 0.35 AS INTEGER) AS predicted_label, round(prob, 6) AS probability_closure, risk_level, "
    "round(score, 6) AS congestion_score, nearest_junction, round(nearest_junction_dist_km, 6) AS nearest_junction_dist_km FROM d"))
def scr_06(spark, sf):
    b = dash_scored(spark, sf)
    return b.select("id", score.decision("prob").alias("predicted_label"), F.round("prob", 6).alias("probability_closure"),
                    "risk_level", F.round("score", 6).alias("congestion_score"), "nearest_junction",
                    F.round("nearest_junction_dist_km", 6).alias("nearest_junction_dist_km"))


@register("scr_07", O.with_ctes(
    f"SELECT id, cause, {O.dmap('cause', {k: v[0] for k, v in TRIAGE.items()}, 'LOW')} AS risk_level, "
    f"{O.dmap('cause', {k: v[1] for k, v in TRIAGE.items()}, 0.1)} AS probability_closure, "
    f"CAST(trunc({O.dmap('cause', {k: v[1] for k, v in TRIAGE.items()}, 0.1)} * 100) AS INTEGER) AS congestion_score FROM "
    f"(SELECT id, {O.dmap(O.case_pick('id % 7', REPORT_CATEGORIES), REPORT_CATEGORY_CAUSE, 'others')} AS cause FROM incidents)"))
def scr_07(spark, sf):
    inc = incidents(spark, sf).select("id", report_cause(pick(F.col("id") % 7, REPORT_CATEGORIES)).alias("cause"))
    return inc.select("id", "cause", *score.triage("cause"))


def planned_events(spark, sf, scored: bool = False) -> DataFrame:
    """Planned incidents as event-planning inputs: crowd, hours, place, weather (derived)."""
    b = (dash_scored if scored else dash_base)(spark, sf).filter(F.col("event_type") == "planned")
    return b.select("id", (F.col("duration_mins") * 200).cast("long").alias("crowd"),
                    (F.lit(1) + F.col("id") % 6).cast("int").alias("hours"), "nearest_junction",
                    pick(F.col("id") % 5, WEATHER_STATES).alias("weather"), *(["score"] if scored else []))


_PLANNED = ("SELECT id, CAST(trunc(duration_mins * 200) AS BIGINT) AS crowd, CAST(1 + id % 6 AS INTEGER) AS hours, "
            f"nearest_junction, {O.case_pick('id % 5', WEATHER_STATES)} AS weather, score FROM d WHERE event_type = 'planned'")


def _risk_sql():
    from roadlens.constants import HIGH_IMPACT_LOCATIONS, MEDIUM_IMPACT_LOCATIONS
    return ("least(100, CASE WHEN crowd >= 50000 THEN 40 WHEN crowd >= 30000 THEN 30 WHEN crowd >= 15000 THEN 20 "
            "WHEN crowd >= 5000 THEN 10 ELSE 5 END + CASE WHEN hours * 60 >= 240 THEN 20 WHEN hours * 60 >= 150 THEN 15 "
            "WHEN hours * 60 >= 90 THEN 10 ELSE 5 END + CASE WHEN nearest_junction IN "
            f"{O.in_list(HIGH_IMPACT_LOCATIONS)} THEN 25 WHEN nearest_junction IN {O.in_list(MEDIUM_IMPACT_LOCATIONS)} "
            "THEN 15 ELSE 10 END + CASE WHEN weather IN ('Stormy', 'Heavy Rain') THEN 15 WHEN weather IN ('Rainy', 'Foggy') "
            "THEN 10 ELSE 2 END)")


@register("scr_08", with_dash(f"SELECT id, {_risk_sql()} AS risk_score FROM pe", pe=_PLANNED))
def scr_08(spark, sf):
    pe = planned_events(spark, sf)
    return pe.select("id", score.event_risk_score("crowd", F.col("hours") * 60, "nearest_junction", "weather").alias("risk_score"))


@register("scr_09", with_dash(
    "SELECT id, CASE WHEN r >= 75 THEN 'CRITICAL' WHEN r >= 50 THEN 'HIGH' WHEN r >= 30 THEN 'MEDIUM' ELSE 'LOW' END "
    "AS congestion_level, CAST(floor(r * 0.9 + 0.5) AS BIGINT) AS traffic_increase_pct, "
    "CAST(floor(r * 0.5 + 0.5) AS BIGINT) AS expected_delay_mins, 16 + CAST(floor(hours / 2.0 + 0.5) AS BIGINT) AS peak_hour, "
    "CASE WHEN crowd > 25000 THEN 'Mega Public Gathering' ELSE 'Public Event' END AS event_type "
    f"FROM (SELECT *, {_risk_sql()} AS r FROM pe)", pe=_PLANNED))
def scr_09(spark, sf):
    pe = planned_events(spark, sf)
    pe = pe.withColumn("r", score.event_risk_score("crowd", F.col("hours") * 60, "nearest_junction", "weather"))
    return pe.select("id", *score.event_forecast("r", "hours", "crowd"))


def _impact_sql():
    mp = O.contains_any("nearest_junction", ["Hebbal", "KR Puram", "Yeshwanthpur"])
    base = (f"CASE WHEN h IN (8, 10) THEN CASE WHEN {mp} THEN 75 ELSE 60 END WHEN h IN (18, 20) THEN CASE WHEN {mp} "
            "THEN 65 ELSE 82 END WHEN h IN (12, 14, 16) THEN 45 WHEN h = 22 THEN 35 ELSE 15 END")
    dpk0 = "abs(h - p)"
    dpk = f"(CASE WHEN {dpk0} > 12 THEN 24 - {dpk0} ELSE {dpk0} END)"
    active = "(CASE WHEN e >= s THEN h >= s AND h <= e ELSE h >= s OR h <= e END)"
    imp = (f"CASE WHEN {active} THEN CAST(floor(inc * greatest(0.0, 1.0 - {dpk} / 3.5) + 0.5) AS BIGINT) "
           "WHEN abs(h - s) < 2 THEN CAST(floor(inc * 0.3 * (1.0 - abs(h - s) / 2.0) + 0.5) AS BIGINT) "
           "WHEN abs(h - e) < 2 THEN CAST(floor(inc * 0.4 * (1.0 - abs(h - e) / 2.0) + 0.5) AS BIGINT) ELSE 0 END")
    return (f"SELECT id, h AS hour, {base} AS baseline, least({base} + {imp}, 99) AS predicted FROM "
            "(SELECT id, nearest_junction, 16 AS s, 16 + hours AS e, 16 + CAST(floor(hours / 2.0 + 0.5) AS BIGINT) AS p, "
            f"CAST(floor({_risk_sql()} * 0.9 + 0.5) AS BIGINT) AS inc FROM pe), (SELECT unnest([6, 8, 10, 12, 14, 16, 18, 20, 22, 24]) AS h)")


@register("scr_10", with_dash(_impact_sql(), pe=_PLANNED))
def scr_10(spark, sf):
    pe = planned_events(spark, sf)
    pe = pe.withColumn("r", score.event_risk_score("crowd", F.col("hours") * 60, "nearest_junction", "weather"))
    pe = pe.select("id", "nearest_junction", F.lit(16).alias("s"), (F.lit(16) + F.col("hours")).alias("e"),
                   (F.lit(16) + score.js_round(F.col("hours") / F.lit(2.0))).alias("p"),
                   score.js_round(F.col("r") * F.lit(0.9)).alias("inc"))
    return score.hourly_impact(pe, "s", "e", "p", "inc", "nearest_junction")


def _plan_sql():
    from roadlens.constants import RESOURCE_CAPACITY, RESOURCE_COST_PER_HOUR, RESOURCE_PLAN
    scale = "CASE WHEN crowd > 25000 THEN 'CRITICAL' WHEN crowd > 12000 THEN 'HIGH' ELSE 'MEDIUM' END"
    q = []
    for item in range(4):
        whens = []
        for kw, table in RESOURCE_PLAN:
            inner = "CASE " + " ".join(f"WHEN sc = '{s}' THEN {v[item]}" for s, v in table.items()) + " ELSE 0 END"
            whens.append(f"WHEN {'contains(nearest_junction, ' + O.q(kw) + ')' if kw else 'true'} THEN {inner}")
        q.append("CASE " + " ".join(whens) + " ELSE 0 END")
    cost = " + ".join(f"{qi} * {c}" for qi, c in zip(q, RESOURCE_COST_PER_HOUR))
    util = " + ".join(f"{qi} / {D(float(c))}" for qi, c in zip(q, RESOURCE_CAPACITY))
    return (f"SELECT id, sc AS scale, {q[0]} AS police, {q[1]} AS barricades, {q[2]} AS marshals, {q[3]} AS emergency, "
            f"({cost}) * hours AS total_cost, CAST(floor(({util}) / 4.0 * 100.0 + 0.5) AS BIGINT) AS utilization "
            f"FROM (SELECT *, {scale} AS sc FROM pe)")


@register("scr_11", with_dash(_plan_sql(), pe=_PLANNED))
def scr_11(spark, sf):
    pe = planned_events(spark, sf)
    return pe.select("id", *score.resource_plan("nearest_junction", "crowd", "hours"))


def _recs_sql():
    from roadlens.constants import RECOMMENDATIONS as R

    def fmt(t):
        parts = t.split("{loc}")
        return " || nearest_junction || ".join(O.q(p) for p in parts) if len(parts) > 1 else O.q(t)
    return (f"SELECT id, list_filter([CASE WHEN crowd > 30000 THEN {fmt(R['crowd_high'])} WHEN crowd > 10000 THEN "
            f"{fmt(R['crowd_mid'])} ELSE {fmt(R['crowd_low'])} END, CASE WHEN dl > 45 THEN {fmt(R['delay_high'])} "
            f"WHEN dl > 20 THEN {fmt(R['delay_mid'])} END, CASE WHEN weather IN ('Rainy', 'Heavy Rain') THEN {O.q(R['rain'])} "
            f"WHEN weather = 'Foggy' THEN {O.q(R['fog'])} END], lambda x: x IS NOT NULL) AS recommendations "
            f"FROM (SELECT *, CAST(floor({_risk_sql()} * 0.5 + 0.5) AS BIGINT) AS dl FROM pe)")


@register("scr_12", with_dash(_recs_sql(), pe=_PLANNED))
def scr_12(spark, sf):
    pe = planned_events(spark, sf)
    pe = pe.withColumn("dl", score.js_round(score.event_risk_score("crowd", F.col("hours") * 60, "nearest_junction",
                                                                   "weather") * F.lit(0.5)))
    return pe.select("id", score.recommendations("nearest_junction", "crowd", "weather", "dl").alias("recommendations"))


@register("scr_13", with_dash(
    "SELECT id, CASE WHEN status = 'RESOLVED' THEN NULL WHEN status = 'ON_SCENE' THEN NULL ELSE "
    f"CAST(floor(greatest(5, CAST(floor(nearest_junction_dist_km * {D(8.0)} + 0.5) AS BIGINT)) * CASE risk_level WHEN 'CRITICAL' "
    f"THEN {D(0.7)} WHEN 'HIGH' THEN {D(0.9)} WHEN 'MEDIUM' THEN {D(1.2)} ELSE {D(1.5)} END + 0.5) AS BIGINT) END AS eta_mins FROM d"))
def scr_13(spark, sf):
    b = dash_base(spark, sf)
    eta = F.when(F.col("status").isin("RESOLVED", "ON_SCENE"), F.lit(None)).otherwise(
        score.arrival_estimate("nearest_junction_dist_km", "risk_level"))
    return b.select("id", eta.alias("eta_mins"))


@register("scr_14", O.with_ctes(
    f"SELECT hr_key, code, rain_mm, coalesce({O.dmap('CAST(code AS VARCHAR)', {str(k): v for k, v in WEATHER_CODES.items()}, None)}, "
    "CASE WHEN rain_mm > 0 THEN 'Drizzle' ELSE 'Partly Cloudy' END) AS weather_condition, "
    "CASE WHEN rain_mm > 10.0 THEN 'HIGH' WHEN rain_mm > 2.0 THEN 'MEDIUM' ELSE 'LOW' END AS flood_risk FROM "
    f"(SELECT strftime(hr, '%Y-%m-%d %H') AS hr_key, {O.case_pick('CAST(epoch(hr) / 3600 AS BIGINT) % 13', list(WEATHER_CODES) + [9999])} AS code, "
    "rain_mm FROM w)",
    w=f"SELECT date_trunc('hour', ts) AS hr, avg(CASE WHEN value > 100 THEN value / {D(20.0)} ELSE {D(0.0)} END) AS rain_mm "
      "FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY 1"))
def scr_14(spark, sf):
    from roadlens.sources.tables import hourly_weather
    w = hourly_weather(spark, sf)
    return w.select(F.date_format("hr", "yyyy-MM-dd HH").alias("hr_key"), "code", "rain_mm",
                    *score.weather_class("code", "rain_mm"))


@register("scr_15", with_dash(
    f"SELECT n_active, smooth_pct, heavy_pct, {D(100.0)} - smooth_pct - heavy_pct AS moderate_pct, weather_delay FROM "
    f"(SELECT n_active, greatest({D(50.0)}, {D(85.0)} - n_active * {D(2.5)}) AS smooth_pct, "
    f"least({D(25.0)}, {D(5.0)} + n_active * {D(1.5)}) AS heavy_pct, weather_delay FROM "
    "(SELECT count(*) FILTER (WHERE status <> 'RESOLVED' AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM d) "
    "AND hour(ts) = 12) AS n_active FROM d), "
    "(SELECT CAST(floor(5.0 + coalesce(max(rain_mm), 0.0) * 1.2 + 0.5) AS BIGINT) AS weather_delay FROM w))",
    w=f"SELECT date_trunc('hour', ts) AS hr, avg(CASE WHEN value > 100 THEN value / {D(20.0)} ELSE {D(0.0)} END) AS rain_mm "
      "FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY 1"))
def scr_15(spark, sf):
    from roadlens.sources.tables import hourly_weather
    return dash.live_traffic_summary(dash_base(spark, sf), hourly_weather(spark, sf))


@register("scr_16", O.with_ctes(
    "SELECT event_id, CASE WHEN density = 'JAMMED' THEN CAST(CAST(floor(queue_length_m / 10.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' "
    "WHEN density = 'HEAVY' THEN CAST(CAST(floor(queue_length_m / 18.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' "
    "WHEN density = 'MODERATE' THEN CAST(CAST(floor(queue_length_m / 30.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' "
    "ELSE '< 2 min' END AS est_delay FROM cam", cam=_cameras_sql()))
def scr_16(spark, sf):
    cam = cameras(spark, sf)
    return cam.select("event_id", score.camera_delay("density", "queue_length_m").alias("est_delay"))


@register("scr_17", with_dash(
    "SELECT id, risk, CASE WHEN raw IN ('closed', 'resolved') THEN 'RESOLVED' WHEN prob > 0.70 THEN 'ON_SCENE' "
    "WHEN prob > 0.40 THEN 'DISPATCHED' ELSE 'PENDING' END AS status, "
    "round_even(least(100.0, CASE WHEN lower(event_cause) IN ('accident', 'flooding') THEN 75 WHEN lower(event_cause) IN "
    "('breakdown', 'construction', 'tree_fall') THEN 55 WHEN lower(event_cause) IN ('pot_holes', 'road_conditions', 'congestion') "
    "THEN 40 ELSE 30 END + prob * 20.0 + CASE WHEN risk = 'CRITICAL' THEN 10.0 ELSE 0.0 END), 1) AS congestion_score FROM "
    "(SELECT *, CASE WHEN requires_road_closure = 1 AND r0 IN ('LOW', 'MEDIUM') THEN 'HIGH' ELSE r0 END AS risk FROM "
    "(SELECT *, CASE upper(priority) WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'CRITICAL' THEN 'CRITICAL' "
    "ELSE 'LOW' END AS r0, CASE WHEN status = 'RESOLVED' THEN 'resolved' ELSE 'active' END AS raw FROM d))"))
def scr_17(spark, sf):
    b = dash_base(spark, sf).withColumn("raw", F.when(F.col("status") == "RESOLVED", "resolved").otherwise("active"))
    out = b.select("id", *score.incident_status("raw", "priority", "requires_road_closure", "prob", "event_cause"))
    return out.select("id", F.col("risk_level").alias("risk"), "status", "congestion_score")


@register("scr_18", with_dash(
    "SELECT id, CASE WHEN crowd > 25000 THEN 55 WHEN crowd > 12000 THEN 45 ELSE 35 END AS reduction_pct, "
    "CAST(floor(CAST(floor(r * 0.5 + 0.5) AS BIGINT) * (CASE WHEN crowd > 25000 THEN 55 WHEN crowd > 12000 THEN 45 ELSE 35 END) "
    "/ 100.0 + 0.5) AS BIGINT) AS time_saved_min, CAST(15 + floor((score - 40) * 0.4) AS BIGINT) AS traffic_saved_min, "
    "CAST(25 + floor((score - 40) * 0.3) AS BIGINT) AS reduction_percent, CAST(1500 + floor((score - 40) * 80) AS BIGINT) "
    f"AS flow_count FROM (SELECT *, {_risk_sql()} AS r FROM pe)", pe=_PLANNED))
def scr_18(spark, sf):
    pe = planned_events(spark, sf, scored=True)
    pe = pe.withColumn("dl", score.js_round(score.event_risk_score("crowd", F.col("hours") * 60, "nearest_junction",
                                                                   "weather") * F.lit(0.5)))
    return pe.select("id", *score.diversion_benefit("crowd", "dl", "score"))


@register("scr_19", O.with_ctes(
    f"SELECT id, pos, feature, value, {D(0.312)} AS base_value, round_even({D(0.312)} + sum(value) OVER (PARTITION BY id), 4) "
    "AS predicted_value FROM (SELECT id, unnest(range(0, 5)) AS pos, unnest(['hour_cause_closure_rate', "
    "'dist_to_city_centre', 'zone_risk_x_hour', 'rolling_3h_system_count', 'if_anomaly_score']) AS feature, "
    f"unnest([CASE WHEN lower(event_cause) = 'accident' THEN {D(0.145)} WHEN lower(event_cause) = 'flooding' THEN {D(0.185)} "
    f"WHEN lower(event_cause) = 'utility work' THEN {D(-0.045)} ELSE {D(0.012)} END, CASE WHEN dc < 3.0 THEN {D(0.098)} "
    f"WHEN dc > 12.0 THEN {D(-0.082)} ELSE {D(0.015)} END, CASE WHEN dc < 6.0 THEN {D(0.062)} ELSE {D(-0.021)} END, "
    f"{D(0.038)}, {D(-0.015)}]) AS value FROM "
    "(SELECT id, event_cause, sqrt(pow(latitude - 12.9716, 2) + pow(longitude - 77.5946, 2)) * 111.0 AS dc FROM incidents))"))
def scr_19(spark, sf):
    return score.explained(incidents(spark, sf).select("id", "event_cause", "latitude", "longitude"))

