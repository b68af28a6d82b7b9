"""Scoring and decision rules (SCR-01..19, TXT-08, GEO-04).

All rules are native CASE/arithmetic expressions; the only model-dependent
operator (``batch_score``) calls a fitted ``pyspark.ml`` PipelineModel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.constants import (
    CONFIDENCE_TIERS, CONGESTION_CAUSE_DEFAULT, CONGESTION_CAUSE_WEIGHT, DECISION_THRESHOLD,
    EARTH_RADIUS_KM, EXPLAIN_BASE, FALLBACK_DEFAULT, FALLBACK_RULES, POLICE_STATIONS, RISK_TIERS,
    TRANSLATION_RULES, TRIAGE, TRIAGE_DEFAULT, WEATHER_CODES,
)
from roadlens.functions.common import col, contains_any, first_match, map_lookup, np_round


def translate(text_col, lang_col) -> Column:
    """TXT-08: rule dictionary by (language, keyword set); first rule in priority order wins.

    The rules are a fixed literal table, so they compile to one CASE (no join)."""
    t, lang = col(text_col), col(lang_col)
    low = F.lower(t)
    rules = [(lang == "en", t)]
    for lg, _, kws, sentence in sorted(TRANSLATION_RULES, key=lambda r: (r[0], r[1])):
        rules.append(((lang == lg) & contains_any(low, kws), F.lit(sentence)))
    fallback = F.concat(F.lit("[Translated from "), F.upper(lang), F.lit("]: "), t)
    return first_match(rules, fallback)


def _atan2_km(lat, lon, la: float, lo: float) -> Column:
    a = (F.pow(F.sin(F.radians(F.lit(la) - col(lat)) / 2), 2)
         + F.cos(F.radians(col(lat))) * F.cos(F.radians(F.lit(la))) * F.pow(F.sin(F.radians(F.lit(lo) - col(lon)) / 2), 2))
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1) - a)))


def nearest_station(lat="latitude", lon="longitude", stations=POLICE_STATIONS) -> tuple[Column, Column]:
    """GEO-04: nearest of a fixed station list, km rounded to 2 dp before comparing
    (ties -> first listed).  The station table is 11 literal rows, so this is one
    projection; a large station table would use a grid-cell equi-join instead."""
    arr = F.array(*[F.struct(np_round(_atan2_km(lat, lon, la, lo), 2).alias("d"), F.lit(i).alias("i"),
                             F.lit(n).alias("n")) for i, (n, la, lo) in enumerate(stations)])
    best = F.array_min(arr)
    return best["n"], best["d"]


def risk_tier(p) -> Column:
    """SCR-02: CRITICAL >= .70, HIGH >= .50, MEDIUM >= .35, else LOW."""
    return first_match([(col(p) >= t, lab) for t, lab in RISK_TIERS], "LOW")


def confidence_tier(p) -> Column:
    """SCR-03: |p - .5| / .5 >= .8 High, >= .6 Medium, else Low."""
    cal = F.abs(col(p) - F.lit(0.5)) / F.lit(0.5)
    return first_match([(cal >= t, lab) for t, lab in CONFIDENCE_TIERS], "Low")


def fallback_probability(cause, lanes, duration) -> Column:
    """SCR-04: cause rule + lanes > 2 (+.10) + duration > 60 (+.05), clamped to [.05, .95]."""
    lc = F.lower(F.coalesce(col(cause).cast("string"), F.lit("none")))
    base = first_match([(contains_any(lc, words), p) for words, p in FALLBACK_RULES], FALLBACK_DEFAULT)
    p = (base + F.when(F.coalesce(col(lanes), F.lit(1)) > 2, 0.10).otherwise(0.0)
         + F.when(F.coalesce(col(duration), F.lit(30.0)) > 60, 0.05).otherwise(0.0))
    return F.least(F.greatest(p, F.lit(0.05)), F.lit(0.95))


def congestion_score(duration, lanes, cause, rolling, prob) -> Column:
    """SCR-05: duration 20 + lanes 20 + cause 25 + rolling density 15 + probability 20, capped at 100."""
    w_dur = F.least(col(duration) / F.lit(120.0), F.lit(1.0)) * F.lit(20.0)
    w_lanes = F.least(col(lanes) / F.lit(4.0), F.lit(1.0)) * F.lit(20.0)
    w_cause = map_lookup(F.lower(col(cause)), CONGESTION_CAUSE_WEIGHT, CONGESTION_CAUSE_DEFAULT)
    w_roll = F.least(col(rolling) / F.lit(10.0), F.lit(1.0)) * F.lit(15.0)
    w_prob = col(prob) * F.lit(20.0)
    return F.least(w_dur + w_lanes + w_cause + w_roll + w_prob, F.lit(100.0))


def decision(p, threshold: float = DECISION_THRESHOLD) -> Column:
    return (col(p) >= F.lit(threshold)).cast("int")


def triage(cause) -> list[Column]:
    """SCR-07: report cause -> risk level, closure probability, integer score."""
    lvl = map_lookup(cause, {k: v[0] for k, v in TRIAGE.items()}, TRIAGE_DEFAULT[0])
    prob = map_lookup(cause, {k: v[1] for k, v in TRIAGE.items()}, TRIAGE_DEFAULT[1])
    return [lvl.alias("risk_level"), prob.alias("probability_closure"),
            (prob * F.lit(100)).cast("int").alias("congestion_score")]


def weather_class(code, rain) -> list[Column]:
    """SCR-14: weather code -> condition (unknown: Drizzle if raining else Partly Cloudy),
    rainfall -> flood risk (> 10 HIGH, > 2 MEDIUM)."""
    cond = F.coalesce(map_lookup(code.cast("string") if isinstance(code, Column) else F.col(code).cast("string"),
                                 {str(k): v for k, v in WEATHER_CODES.items()}),
                      F.when(col(rain) > 0, "Drizzle").otherwise("Partly Cloudy"))
    flood = F.when(col(rain) > 10.0, "HIGH").when(col(rain) > 2.0, "MEDIUM").otherwise("LOW")
    return [cond.alias("weather_condition"), flood.alias("flood_risk")]


def explanation_terms(cause, lat, lon) -> Column:
    """SCR-19: additive rule explanation as array<struct<feature, value, description>>."""
    lc = F.lower(col(cause))
    dist = F.sqrt(F.pow(col(lat) - F.lit(12.9716), 2) + F.pow(col(lon) - F.lit(77.5946), 2)) * F.lit(111.0)
    cause_v = first_match([(lc == "accident", 0.145), (lc == "flooding", 0.185), (lc == "utility work", -0.045)], 0.012)
    dist_v = first_match([(dist < 3.0, 0.098), (dist > 12.0, -0.082)], 0.015)
    zone_v = F.when(dist < 6.0, 0.062).otherwise(-0.021)

    def term(name, v):
        return F.struct(F.lit(name).alias("feature"), v.cast("double").alias("value"))
    return F.array(term("hour_cause_closure_rate", cause_v), term("dist_to_city_centre", dist_v),
                   term("zone_risk_x_hour", zone_v), term("rolling_3h_system_count", F.lit(0.038)),
                   term("if_anomaly_score", F.lit(-0.015)))


def explained(df: DataFrame, cause="event_cause", lat="latitude", lon="longitude", key="id") -> DataFrame:
    """SCR-19 long form: one row per (row, term) + predicted value = base + sum."""
    terms = explanation_terms(cause, lat, lon)
    pred = F.aggregate(terms, F.lit(EXPLAIN_BASE), lambda acc, t: acc + t["value"])
    return (df.select(key, np_round(pred, 4).alias("predicted_value"), F.posexplode(terms).alias("pos", "t"))
            .select(key, "pos", F.col("t.feature").alias("feature"), F.col("t.value").alias("value"),
                    F.lit(EXPLAIN_BASE).alias("base_value"), "predicted_value"))


def direction(v) -> Column:
    return F.when(col(v) > 0, "increase").when(col(v) < 0, "decrease").otherwise("neutral")


# ---------------------------------------------------------------- event planning rules (SCR-08..18)

def event_risk_score(crowd, duration_min, location, weather) -> Column:
    """SCR-08: crowd + duration + location + weather points, capped at 100."""
    from roadlens.constants import HIGH_IMPACT_LOCATIONS, MEDIUM_IMPACT_LOCATIONS
    c, d = col(crowd), col(duration_min)
    crowd_pts = first_match([(c >= 50000, 40), (c >= 30000, 30), (c >= 15000, 20), (c >= 5000, 10)], 5)
    dur_pts = first_match([(d >= 240, 20), (d >= 150, 15), (d >= 90, 10)], 5)
    loc_pts = first_match([(col(location).isin(HIGH_IMPACT_LOCATIONS), 25),
                           (col(location).isin(MEDIUM_IMPACT_LOCATIONS), 15)], 10)
    w_pts = first_match([(col(weather).isin("Stormy", "Heavy Rain"), 15), (col(weather).isin("Rainy", "Foggy"), 10)], 2)
    return F.least(F.lit(100), crowd_pts + dur_pts + loc_pts + w_pts)


def js_round(c) -> Column:
    """JavaScript Math.round: half toward +infinity."""
    return F.floor(col(c) + F.lit(0.5)).cast("long")


def event_forecast(risk, duration_h, crowd) -> list[Column]:
    """SCR-09: congestion level 75/50/30, traffic increase %, delay, peak hour, event type."""
    r = col(risk)
    return [first_match([(r >= 75, "CRITICAL"), (r >= 50, "HIGH"), (r >= 30, "MEDIUM")], "LOW").alias("congestion_level"),
            js_round(r * F.lit(0.9)).alias("traffic_increase_pct"),
            js_round(r * F.lit(0.5)).alias("expected_delay_mins"),
            (F.lit(16) + js_round(col(duration_h) / F.lit(2.0))).alias("peak_hour"),
            F.when(col(crowd) > 25000, "Mega Public Gathering").otherwise("Public Event").alias("event_type")]


def hourly_impact(df: DataFrame, start_h, end_h, peak_h, increase, location, key="id") -> DataFrame:
    """SCR-10: baseline by hour class + triangular event impact (wrap at midnight), cap 99.

    One row per (key, hour) via a fixed 10-element explode (bounded fan-out)."""
    from roadlens.constants import IMPACT_HOURS, MORNING_PEAK_PLACES
    ex = df.select(key, col(start_h).alias("s"), col(end_h).alias("e"), col(peak_h).alias("p"),
                   col(increase).alias("inc"), contains_any(col(location), MORNING_PEAK_PLACES).alias("mp"),
                   F.explode(F.array(*[F.lit(h) for h in IMPACT_HOURS])).alias("hour"))
    h = F.col("hour")
    base = first_match([(h.isin(8, 10), F.when(F.col("mp"), 75).otherwise(60)),
                        (h.isin(18, 20), F.when(F.col("mp"), 65).otherwise(82)),
                        (h.isin(12, 14, 16), F.lit(45)), (h == 22, F.lit(35))], 15)
    active = F.when(F.col("e") >= F.col("s"), (h >= F.col("s")) & (h <= F.col("e"))) \
        .otherwise((h >= F.col("s")) | (h <= F.col("e")))
    dpk = F.abs(h - F.col("p"))
    dpk = F.when(dpk > 12, F.lit(24) - dpk).otherwise(dpk)
    factor = F.greatest(F.lit(0.0), F.lit(1.0) - dpk / F.lit(3.5))
    ds, de = F.abs(h - F.col("s")), F.abs(h - F.col("e"))
    inactive = first_match([(ds < 2, js_round(F.col("inc") * F.lit(0.3) * (F.lit(1.0) - ds / F.lit(2.0)))),
                            (de < 2, js_round(F.col("inc") * F.lit(0.4) * (F.lit(1.0) - de / F.lit(2.0))))], 0)
    impact = F.when(active, js_round(F.col("inc") * factor)).otherwise(inactive)
    return ex.select(key, "hour", base.alias("baseline"), F.least(base + impact, F.lit(99)).alias("predicted"))


def resource_plan(junction, crowd, hours) -> list[Column]:
    """SCR-11: quantities by junction family x crowd scale, total cost x hours, utilisation %."""
    from roadlens.constants import RESOURCE_CAPACITY, RESOURCE_COST_PER_HOUR, RESOURCE_PLAN
    c = col(crowd)
    scale = first_match([(c > 25000, "CRITICAL"), (c > 12000, "HIGH")], "MEDIUM")
    qty = []
    for item in range(4):
        rules = []
        for kw, table in RESOURCE_PLAN:
            pick = first_match([(scale == s, v[item]) for s, v in table.items()], 0)
            rules.append((F.contains(col(junction), F.lit(kw)) if kw else F.lit(True), pick))
        qty.append(first_match(rules, 0))
    cost = sum((q * F.lit(cph) for q, cph in zip(qty, RESOURCE_COST_PER_HOUR)), F.lit(0)) * col(hours)
    util = js_round(sum((q / F.lit(float(cap)) for q, cap in zip(qty, RESOURCE_CAPACITY)), F.lit(0.0))
                    / F.lit(4.0) * F.lit(100.0))
    return [scale.alias("scale"), qty[0].alias("police"), qty[1].alias("barricades"), qty[2].alias("marshals"),
            qty[3].alias("emergency"), cost.alias("total_cost"), util.alias("utilization")]


def recommendations(location, crowd, weather, delay) -> Column:
    """SCR-12: rule recommendations as an array (NULLs compacted away)."""
    from roadlens.constants import RECOMMENDATIONS as R
    c, d, w = col(crowd), col(delay), col(weather)

    def fmt(t):
        parts = t.split("{loc}")
        return F.concat(*[x for p in parts for x in (F.lit(p), col(location))][:-1]) if len(parts) > 1 else F.lit(t)
    return F.array_compact(F.array(
        first_match([(c > 30000, fmt(R["crowd_high"])), (c > 10000, fmt(R["crowd_mid"]))], fmt(R["crowd_low"])),
        F.when(d > 45, fmt(R["delay_high"])).when(d > 20, fmt(R["delay_mid"])),
        F.when(w.isin("Rainy", "Heavy Rain"), F.lit(R["rain"])).when(w == "Foggy", F.lit(R["fog"]))))


def arrival_estimate(km, risk_level) -> Column:
    """SCR-13: round(max(5, round(km*8)) * priority factor)."""
    base = F.greatest(F.lit(5), js_round(col(km) * F.lit(8.0)))
    factor = first_match([(col(risk_level) == "CRITICAL", 0.7), (col(risk_level) == "HIGH", 0.9),
                          (col(risk_level) == "MEDIUM", 1.2)], 1.5)
    return js_round(base * factor)


def traffic_mix(active_count) -> list[Column]:
    """SCR-15: smooth/heavy/moderate shares from the active incident count."""
    n = col(active_count)
    smooth = F.greatest(F.lit(50.0), F.lit(85.0) - n * F.lit(2.5))
    heavy = F.least(F.lit(25.0), F.lit(5.0) + n * F.lit(1.5))
    return [smooth.alias("smooth_pct"), heavy.alias("heavy_pct"), (F.lit(100.0) - smooth - heavy).alias("moderate_pct")]


def weather_delay(rain) -> Column:
    """SCR-15: round(5 + 1.2 * rainfall)."""
    return js_round(F.lit(5.0) + F.coalesce(col(rain), F.lit(0.0)) * F.lit(1.2))


def camera_delay(density, queue) -> Column:
    """SCR-16: queue / {10, 18, 30} by density, else '< 2 min'."""
    d, q = col(density), col(queue)
    return first_match([(d == "JAMMED", F.concat(js_round(q / F.lit(10.0)).cast("string"), F.lit(" min"))),
                        (d == "HEAVY", F.concat(js_round(q / F.lit(18.0)).cast("string"), F.lit(" min"))),
                        (d == "MODERATE", F.concat(js_round(q / F.lit(30.0)).cast("string"), F.lit(" min")))],
                       "< 2 min")


def incident_status(raw_status, priority, closure, prob, cause) -> list[Column]:
    """SCR-17: risk level from priority (+ closure upgrade), status from raw status and
    probability, congestion score from cause + probability (+10 when CRITICAL), 1 dp."""
    pr = F.upper(F.coalesce(col(priority), F.lit("Low")))
    risk = first_match([(pr == "HIGH", "HIGH"), (pr == "MEDIUM", "MEDIUM"), (pr == "CRITICAL", "CRITICAL")], "LOW")
    risk = F.when((col(closure) == 1) & risk.isin("LOW", "MEDIUM"), F.lit("HIGH")).otherwise(risk)
    status = first_match([(col(raw_status).isin("closed", "resolved"), "RESOLVED"), (col(prob) > 0.70, "ON_SCENE"),
                          (col(prob) > 0.40, "DISPATCHED")], "PENDING")
    lc = F.lower(F.coalesce(col(cause), F.lit("others")))
    base = first_match([(lc.isin("accident", "flooding"), 75), (lc.isin("breakdown", "construction", "tree_fall"), 55),
                        (lc.isin("pot_holes", "road_conditions", "congestion"), 40)], 30)
    score = F.least(F.lit(100.0), base + col(prob) * F.lit(20.0) + F.when(risk == "CRITICAL", 10.0).otherwise(0.0))
    return [risk.alias("risk_level"), status.alias("status"), np_round(score, 1).alias("congestion_score")]


def diversion_benefit(crowd, delay, score) -> list[Column]:
    """SCR-18: reduction 55/45/35 % by crowd, minutes saved; per-location saved minutes,
    reduction and redirected flow from the base score."""
    c = col(crowd)
    pct = first_match([(c > 25000, 55), (c > 12000, 45)], 35)
    s = col(score) - F.lit(40)
    return [pct.alias("reduction_pct"), js_round(F.coalesce(col(delay), F.lit(45)) * pct / F.lit(100.0)).alias("time_saved_min"),
            (F.lit(15) + F.floor(s * F.lit(0.4))).cast("long").alias("traffic_saved_min"),
            (F.lit(25) + F.floor(s * F.lit(0.3))).cast("long").alias("reduction_percent"),
            (F.lit(1500) + F.floor(s * F.lit(80))).cast("long").alias("flow_count")]
