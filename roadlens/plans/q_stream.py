"""Streaming queries (STR-01..07), replayed with ``availableNow`` and compared with
their batch equivalents where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.constants import TRIAGE
from roadlens.operators import score
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.q_core import _station_sql
from roadlens.plans.q_dash import _prob_sql
from roadlens.sources.tables import cameras, cameras_from, hourly_weather, incidents
from roadlens.streaming import jobs

@register("str_01", O.with_ctes(f"""
SELECT id, event_cause, len(errs) = 0 AS is_valid, errs AS errors, ns.n AS nearest_station, ns.d AS station_km,
       {O.dmap('event_cause', {k: v[0] for k, v in TRIAGE.items()}, 'LOW')} AS risk_level,
       {O.dmap('event_cause', {k: v[1] for k, v in TRIAGE.items()}, 0.1)} AS probability_closure,
       CAST(trunc({O.dmap('event_cause', {k: v[1] for k, v in TRIAGE.items()}, 0.1)} * 100) AS INTEGER) AS congestion_score
FROM (SELECT *, {_station_sql()} AS ns, list_filter([
    CASE WHEN start_datetime IS NULL THEN 'start_datetime is required'
         WHEN try_cast(start_datetime AS TIMESTAMP) IS NULL THEN 'start_datetime is not a valid timestamp' END,
    CASE WHEN latitude IS NULL THEN 'latitude is required'
         WHEN NOT (latitude BETWEEN 12.7 AND 13.2) THEN 'latitude outside service area' END,
    CASE WHEN longitude IS NULL THEN 'longitude is required'
         WHEN NOT (longitude BETWEEN 77.4 AND 77.8) THEN 'longitude outside service area' END
  ], lambda x: x IS NOT NULL) AS errs FROM incidents)"""))
def str_01(spark, sf):
    out = jobs.run_available(jobs.intake(jobs.incident_stream(spark, sf)), "intake")
    return out.drop("ts")


def _with_duplicates(stream):
    """Each report arrives once, every third one twice (same id, same time)."""
    copies = F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return stream.filter(F.col("ts").isNotNull()).select("*", F.explode(copies).alias("copy"))


@register("str_02", O.with_ctes("SELECT id, status FROM incidents WHERE ts IS NOT NULL"))
def str_02(spark, sf):
    s = _with_duplicates(jobs.incident_stream(spark, sf))
    return jobs.run_available(jobs.dedupe(s).select("id", "status"), "dedupe")


def _with_updates(stream):
    """Every third report is followed by a RESOLVED update ten minutes later."""
    upd = F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = stream.filter(F.col("ts").isNotNull()).select("*", F.explode(upd).alias("u"))
    return x.select("id", F.when(F.col("u") == 1, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("ts")).alias("ts"),
                    F.when(F.col("u") == 1, F.lit("RESOLVED")).otherwise(F.col("status")).alias("status"))


@register("str_03", O.with_ctes(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'RESOLVED' ELSE status END AS status FROM incidents WHERE ts IS NOT NULL"))
def str_03(spark, sf):
    s = _with_updates(jobs.incident_stream(spark, sf))
    return jobs.compact_status(jobs.run_available(jobs.latest_status(s), "latest", ["span", "id"])).select("id", "status")


@register("str_04", O.with_ctes("""
SELECT hours, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start,
       time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE + hours * INTERVAL 1 HOUR AS window_end,
       coalesce(corridor, 'unknown') AS corridor, count(*) AS n
FROM incidents, (SELECT 3 AS hours, unnest(range(36)) AS k UNION ALL SELECT 6, unnest(range(72)))
WHERE ts IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def str_04(spark, sf):
    """Counts in windows of 3 h and 6 h that slide by 5 minutes, per corridor."""
    out = None
    for hours in (3, 6):
        s = jobs.rolling_counts(jobs.incident_stream(spark, sf), f"{hours} hours", "5 minutes")
        got = jobs.run_available(s, f"rolling{hours}", ["window_start", "window_end", "corridor"]).withColumn("hours", F.lit(hours))
        out = got if out is None else out.unionByName(got)
    return out


@register("str_04_live", O.with_ctes("""
SELECT id, ts, corridor, n_3h, n_6h FROM (
  SELECT id, ts, coalesce(corridor, 'unknown') AS corridor,
         count(*) OVER (w RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (w RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS n_3h,
         count(*) OVER (w RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (w RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS n_6h
  FROM incidents WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY coalesce(corridor, 'unknown') ORDER BY ts))
WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM incidents)"""))
def str_04_live(spark, sf):
    """Per report the reports of its corridor in the 3 h and 6 h before it; those the watermark has passed."""
    return jobs.run_available(jobs.live_counts(jobs.incident_stream(spark, sf)), "live")


def _warning_sql():
    from roadlens.plans.q_dash import _cameras_sql
    D = O.d
    lc, ld = "lower(coalesce(event_cause, ''))", "lower(coalesce(description, ''))"
    ctes = dict(
        cam=_cameras_sql(),
        r=f"""SELECT date_trunc('hour', ts) AS w,
                count(*) FILTER (WHERE contains({lc}, 'water') OR contains({lc}, 'flood') OR contains({ld}, 'water')) AS n_water,
                count(*) FILTER (WHERE contains({lc}, 'accident') OR contains({lc}, 'crash') OR contains({ld}, 'accident')) AS n_accident,
                count(*) FILTER (WHERE contains({lc}, 'construction') OR contains({ld}, 'repair') OR contains({ld}, 'work')) AS n_work
              FROM incidents WHERE status IN ('PENDING', 'DISPATCHED', 'ON_SCENE') AND ts IS NOT NULL GROUP BY 1""",
        c="""SELECT date_trunc('hour', ts) AS w, count(*) FILTER (WHERE density IN ('JAMMED', 'HEAVY') OR queue_length_m > 200)
               AS n_cam, max(queue_length_m) FILTER (WHERE density IN ('JAMMED', 'HEAVY') OR queue_length_m > 200) AS queue
             FROM cam WHERE ts IS NOT NULL GROUP BY 1""",
        wx=f"""SELECT date_trunc('hour', ts) AS w, avg(CASE WHEN value > 100 THEN value / {D(20.0)} ELSE {D(0.0)} END) AS rain
               FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY 1""",
        j=f"""SELECT coalesce(r.w, c.w, wx.w) AS w, coalesce(n_water, 0) AS n_water, coalesce(n_accident, 0) AS n_accident,
                    coalesce(n_work, 0) AS n_work, coalesce(n_cam, 0) AS n_cam, coalesce(queue, 0) AS queue,
                    coalesce(rain, {D(0.0)}) AS rain, {D(10.0)} - least(coalesce(rain, {D(0.0)}), {D(16.0)}) / 2 AS sight
             FROM r FULL OUTER JOIN c ON r.w = c.w FULL OUTER JOIN wx ON coalesce(r.w, c.w) = wx.w""",
        warn="""SELECT w AS window_start, n_water, n_accident, n_work, n_cam AS n_congested_cams, round_even(rain, 6) AS rain_mm,
                  CASE WHEN n_cam = 0 THEN 'MEDIUM' WHEN queue > 350 THEN 'CRITICAL' ELSE 'HIGH' END AS congestion_level,
                  CASE WHEN NOT (rain > 2 OR sight < 6 OR n_accident > 0) THEN 'MEDIUM' WHEN rain > 10 THEN 'CRITICAL'
                       ELSE 'HIGH' END AS accident_level,
                  CASE WHEN rain > 10 OR n_water > 0 THEN 'CRITICAL' WHEN rain > 5 THEN 'HIGH' ELSE 'LOW' END AS flood_level,
                  CASE WHEN hour(w) >= 16 THEN 'HIGH' ELSE 'MEDIUM' END AS event_level,
                  CASE WHEN n_work > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS infrastructure_level FROM j""")
    return ctes


@register("str_05", O.with_ctes("SELECT * FROM warn", **_warning_sql()))
def str_05(spark, sf):
    return jobs.early_warning(incidents(spark, sf), cameras(spark, sf), hourly_weather(spark, sf))


def _feeds(spark, sf):
    """The three feeds of the warning rules as streams."""
    ev = jobs.event_stream(spark, sf)
    v = F.col("value")
    rain = ev.filter(F.col("event_type") == "view").select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(v > 100, v / F.lit(20.0)).otherwise(F.lit(0.0)).alias("rain_mm"))
    return jobs.incident_stream(spark, sf), cameras_from(jobs.event_stream(spark, sf)), rain


def _live_warning(spark, sf):
    return jobs.run_available(jobs.early_warning_stream(*_feeds(spark, sf)), "warning", ["window_start"])


def _alerts_sql():
    from roadlens.streaming.jobs import ALERTS
    of = {"congestion": "n_congested_cams", "accident": "n_accident", "flood": "n_water", "event": "0", "infrastructure": "n_work"}
    return " UNION ALL ".join(
        f"SELECT window_start, '{i}' AS alert_id, '{c}' AS category, {n}_level AS risk_level, CASE WHEN {n}_level = '{calm}' THEN '{later}' "
        f"ELSE '{soon}' END AS timeframe, CAST({of[n]} AS BIGINT) AS n_sources, "
        f"{'rain_mm' if n in ('accident', 'flood') else 'CAST(NULL AS DOUBLE)'} AS rain_mm FROM warn"
        for n, (i, c, calm, soon, later) in ALERTS.items())


@register("str_05_stream", O.with_ctes("SELECT * FROM warn", **_warning_sql()))
def str_05_stream(spark, sf):
    return _live_warning(spark, sf)


@register("str_05_alerts", O.with_ctes(_alerts_sql(), **_warning_sql()))
def str_05_alerts(spark, sf):
    return jobs.alert_rows(_live_warning(spark, sf))


def _horizon_sql():
    D = O.d
    cam = "CASE WHEN n_congested_cams > 0 THEN {} ELSE 0 END"
    idx = {"30m": f"least(30 + {cam.format(30)} + least(rain_mm * 2, {D(30.0)}), {D(98.0)})",
           "1h": f"least(25 + {cam.format(20)} + least(rain_mm * {D(1.5)}, {D(25.0)}), {D(90.0)})",
           "2h": f"least(15 + least(rain_mm, {D(20.0)}), {D(80.0)})"}
    grade = "CASE WHEN {c} > 70 THEN '{0}' WHEN {c} > 50 THEN '{1}' WHEN {c} > 30 THEN '{2}' ELSE '{3}' END"
    cols = ", ".join(f"round_even(t{h}, 1) AS risk_{h}, {grade.format('critical', 'high', 'medium', 'low', c=f't{h}')} AS status_{h}, "
                     f"{grade.format('RED', 'ORANGE', 'YELLOW', 'GREEN', c=f't{h}')} AS alert_{h}" for h in idx)
    return (f"SELECT window_start, {cols}, CASE WHEN t30m > t1h THEN 'UPWARD' ELSE 'STABLE' END AS trend_30m, "
            "CASE WHEN abs(t1h - t2h) < 5 THEN 'STABLE' WHEN t1h > t2h THEN 'UPWARD' ELSE 'DOWNWARD' END AS trend_1h, "
            "CASE WHEN t2h < t1h THEN 'DOWNWARD' ELSE 'STABLE' END AS trend_2h FROM (SELECT window_start, "
            + ", ".join(f"{e} AS t{h}" for h, e in idx.items()) + " FROM warn)")


@register("str_06", O.with_ctes(_horizon_sql(), **_warning_sql()))
def str_06(spark, sf):
    return jobs.horizon_risk(jobs.early_warning(incidents(spark, sf), cameras(spark, sf), hourly_weather(spark, sf)))


@register("str_06_stream", O.with_ctes(_horizon_sql(), **_warning_sql()))
def str_06_stream(spark, sf):
    return jobs.horizon_risk(_live_warning(spark, sf))


def _scored_stream(stream):
    prob = score.fallback_probability("event_cause", "num_lanes", "duration_mins")
    model = F.when(F.col("event_type") == "planned", "rule_fallback").otherwise("closure_model")
    return stream.select("id", "ts", model.alias("model"), (F.col("duration_mins") / F.lit(10.0)).alias("latency_ms"),
                         F.greatest(prob, F.lit(1.0) - prob).alias("confidence"))


@register("str_07", O.with_ctes(f"""
SELECT date_trunc('hour', ts) AS window_start, model, count(*) AS n, avg(latency_ms) AS avg_latency_ms,
       avg(confidence) AS avg_confidence FROM (
  SELECT ts, CASE WHEN event_type = 'planned' THEN 'rule_fallback' ELSE 'closure_model' END AS model,
         duration_mins / 10.0 AS latency_ms, greatest(p, 1.0 - p) AS confidence
  FROM (SELECT *, {_prob_sql()} AS p FROM incidents))
WHERE ts IS NOT NULL GROUP BY 1, 2"""))
def str_07(spark, sf):
    s = _scored_stream(jobs.incident_stream(spark, sf))
    return jobs.run_available(jobs.telemetry(s), "telemetry", ["window_start", "model"])


@register("str_07_last100", O.with_ctes(f"""
SELECT model, count(*) AS n, avg(latency_ms) AS avg_latency_ms, avg(confidence) AS avg_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, id DESC) AS k FROM (
    SELECT id, ts, CASE WHEN event_type = 'planned' THEN 'rule_fallback' ELSE 'closure_model' END AS model,
           duration_mins / 10.0 AS latency_ms, greatest(p, 1.0 - p) AS confidence
    FROM (SELECT *, {_prob_sql()} AS p FROM incidents) WHERE ts IS NOT NULL))
WHERE k <= 100 GROUP BY 1"""))
def str_07_last100(spark, sf):
    return jobs.recent_means(jobs.run_recent(_scored_stream(jobs.incident_stream(spark, sf))))
