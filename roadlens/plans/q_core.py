"""Flagship + stateless column operators (CLN, PRJ, FLT, TXT, DTM, GEO, EVT)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadlens.constants import (
    ACTIVE_FAMILIES, ADDRESS_KEYWORDS, AIRPORT, CAUSE_CATEGORY, CAUSE_DISPLAY, CAUSE_PRIORITY,
    CAUSE_SEVERITY, CITY_CENTRE, DESCRIPTION_KEYWORDS, HEAVY_VEHICLES, JUNCTIONS, POLICE_STATIONS,
    PUBLIC_TRANSPORT, REPORT_CATEGORY_CAUSE, REQUEST_BOUNDS, RISK_JUNCTIONS, VEHICLE_RISK,
)
from roadlens.functions import geo, temporal, text
from roadlens.functions.common import np_round
from roadlens.operators import clean, events, impute
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.hotspots import closure_hotspots, HOTSPOTS_SQL, nearest_junction_planar
from roadlens.sources.tables import incidents, pick, read_table

TWO_PI = 2 * math.pi

register("closure_hotspots", HOTSPOTS_SQL)(closure_hotspots)


# ---------------------------------------------------------------- cleaning / projections

@register("cln_01", O.with_ctes("SELECT * EXCLUDE (ts, created_ts, address, description, start_datetime) FROM incidents"))
def cln_01(spark, sf):
    return clean.drop_columns(incidents(spark, sf), ["ts", "created_ts", "address", "description",
                                                     "start_datetime", "not_a_column"])


@register("cln_02", O.with_ctes("SELECT DISTINCT event_cause, zone, priority, num_lanes FROM incidents"))
def cln_02(spark, sf):
    return clean.dedupe(incidents(spark, sf).select("event_cause", "zone", "priority", "num_lanes"))


@register("cln_02_report", O.with_ctes(
    "SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT event_cause, zone, priority, num_lanes "
    "FROM incidents)) AS rows_after, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_cause, zone, priority, "
    "num_lanes FROM incidents)) AS rows_removed FROM incidents"))
def cln_02_report(spark, sf):
    return clean.duplicate_count(incidents(spark, sf).select("event_cause", "zone", "priority", "num_lanes"))


_RB = REQUEST_BOUNDS
_COORD_SQL = (f"CASE WHEN coalesce(latitude BETWEEN {_RB['latitude'][0]} AND {_RB['latitude'][1]} AND longitude "
              f"BETWEEN {_RB['longitude'][0]} AND {_RB['longitude'][1]}, false) THEN 0 ELSE 1 END")


@register("cln_03", O.with_ctes(f"SELECT id, {_COORD_SQL} AS coord_out_of_bounds FROM incidents"))
def cln_03(spark, sf):
    return incidents(spark, sf).select("id", clean.coord_flag(bounds=REQUEST_BOUNDS).alias("coord_out_of_bounds"))


@register("cln_04", O.with_ctes(
    "SELECT id, CASE WHEN try_cast(start_datetime AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END AS datetime_parse_failed "
    "FROM incidents"))
def cln_04(spark, sf):
    return incidents(spark, sf).select("id", clean.ts_parse_flag("start_datetime").alias("datetime_parse_failed"))


@register("cln_05", O.with_ctes(
    "SELECT DISTINCT * EXCLUDE (ts, created_ts, description, address), "
    "CASE WHEN coalesce(latitude BETWEEN 12.5 AND 13.5 AND longitude BETWEEN 77.0 AND 78.0, false) THEN 0 ELSE 1 END "
    "AS coord_out_of_bounds, "
    "CASE WHEN try_cast(start_datetime AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END AS datetime_parse_failed FROM incidents"))
def cln_05(spark, sf):
    inc = incidents(spark, sf)
    twice = inc.unionByName(inc.filter("id % 10 = 0"))        # every tenth report arrives twice
    return clean.clean(twice, drop=["ts", "created_ts", "description", "address"])


@register("prj_01", O.with_ctes(
    "SELECT id, CAST(requires_road_closure AS INTEGER) AS y_closure, CASE WHEN priority = 'High' THEN 1 ELSE 0 END "
    "AS y_priority FROM incidents"))
def prj_01(spark, sf):
    df = incidents(spark, sf).select("id", "requires_road_closure", "priority", "event_cause")
    return clean.extract_targets(df)


@register("prj_02", O.with_ctes(
    "SELECT id, start_datetime, latitude, longitude, event_cause, CAST(NULL AS VARCHAR) AS zone_id, "
    "CAST(NULL AS VARCHAR) AS road_category FROM incidents"))
def prj_02(spark, sf):
    from roadlens.sources.scans import EVENT_INPUT
    df = incidents(spark, sf).select("id", "start_datetime", "latitude", "longitude", "event_cause")
    return clean.pad_columns(df, EVENT_INPUT).select("id", "start_datetime", "latitude", "longitude",
                                                     "event_cause", "zone_id", "road_category")


@register("prj_03", O.with_ctes(
    "SELECT id, coalesce(CAST(duration_mins AS DOUBLE), 0.0) AS duration_mins, "
    "coalesce(CAST(num_lanes AS DOUBLE), 0.0) AS num_lanes, CAST(0.0 AS DOUBLE) AS rolling_3h_system_count "
    "FROM incidents"))
def prj_03(spark, sf):
    return clean.align_features(incidents(spark, sf), ["duration_mins", "num_lanes", "rolling_3h_system_count"],
                                keep=["id"])


@register("prj_04", O.with_ctes(
    "SELECT id, coalesce(CAST(latitude AS DOUBLE), 0.0) AS latitude, coalesce(CAST(longitude AS DOUBLE), 0.0) "
    "AS longitude, coalesce(CAST(duration_mins AS DOUBLE), 0.0) AS duration_mins, "
    "coalesce(CAST(num_lanes AS DOUBLE), 0.0) AS num_lanes FROM incidents"))
def prj_04(spark, sf):
    return clean.model_matrix(incidents(spark, sf).drop("requires_road_closure", "is_train"), keep=["id"])


@register("prj_05", O.with_ctes(f"""
SELECT id, errs AS errors, len(errs) = 0 AS is_valid FROM (
  SELECT id, list_filter([
    CASE WHEN start_datetime IS NULL THEN 'start_datetime is required'
         WHEN try_cast(start_datetime AS TIMESTAMP) IS NULL THEN 'start_datetime is not a valid timestamp' END,
    CASE WHEN latitude IS NULL THEN 'latitude is required'
         WHEN NOT (latitude BETWEEN {_RB['latitude'][0]} AND {_RB['latitude'][1]}) THEN 'latitude outside service area' END,
    CASE WHEN longitude IS NULL THEN 'longitude is required'
         WHEN NOT (longitude BETWEEN {_RB['longitude'][0]} AND {_RB['longitude'][1]}) THEN 'longitude outside service area' END
  ], lambda x: x IS NOT NULL) AS errs FROM incidents)"""))
def prj_05(spark, sf):
    df = incidents(spark, sf).select("id", "start_datetime", "latitude", "longitude")
    return clean.validate_rows(df).select("id", "errors", "is_valid")


# ---------------------------------------------------------------- filters

@register("flt_01", O.with_ctes("""
SELECT id, event_cause, priority, status FROM incidents
WHERE (contains(lower(CAST(id AS VARCHAR)), 'road') OR contains(lower(coalesce(junction, '')), 'road')
       OR contains(lower(coalesce(description, '')), 'road') OR contains(lower(coalesce(address, '')), 'road'))
  AND contains(lower(event_cause), 'water') AND priority = 'High'"""))
def flt_01(spark, sf):
    from roadlens.operators.dashboards import search_filter
    df = incidents(spark, sf).select("id", "event_cause", "priority", "status", "junction", "description", "address")
    out = search_filter(df, "road", ["id", "junction", "description", "address"],
                        category=("event_cause", "water"), equals={"priority": "High", "status": "All"})
    return out.select("id", "event_cause", "priority", "status")


@register("flt_02", O.with_ctes("SELECT id, zone FROM incidents WHERE lower(zone) = lower('EAST')"))
def flt_02(spark, sf):
    from roadlens.operators.dashboards import equals_ci
    return equals_ci(incidents(spark, sf).select("id", "zone"), {"zone": "EAST"})


@register("flt_03", O.with_ctes(
    "SELECT id, starts_with(CAST(id AS VARCHAR), '77') AS id_prefix_match, "
    "contains(coalesce(description, ''), 'Accident') AS sos_match FROM incidents "
    "WHERE starts_with(CAST(id AS VARCHAR), '77') OR contains(coalesce(description, ''), 'Accident')"))
def flt_03(spark, sf):
    df = incidents(spark, sf).select("id", "description")
    p = F.startswith(F.col("id").cast("string"), F.lit("77"))
    s = F.contains(F.coalesce(F.col("description"), F.lit("")), F.lit("Accident"))
    return df.filter(p | s).select("id", p.alias("id_prefix_match"), s.alias("sos_match"))


def _family_sql(name):
    cw, dw = ACTIVE_FAMILIES[name]
    lc, ld = "lower(coalesce(event_cause, ''))", "lower(coalesce(description, ''))"
    return f"({O.contains_any(lc, cw)} OR {O.contains_any(ld, dw)})"


@register("flt_04", O.with_ctes(f"""
SELECT id, status, {_family_sql('water')} AS is_water, {_family_sql('accident')} AS is_accident,
       {_family_sql('construction')} AS is_construction FROM incidents
WHERE status IN ('PENDING', 'DISPATCHED', 'ON_SCENE')
  AND ({_family_sql('water')} OR {_family_sql('accident')} OR {_family_sql('construction')})"""))
def flt_04(spark, sf):
    from roadlens.operators.dashboards import active_families
    return active_families(incidents(spark, sf).select("id", "status", "event_cause", "description"))


# ---------------------------------------------------------------- imputation (stateless)

@register("imp_02", O.with_ctes(
    "SELECT id, coalesce(veh_type, 'unknown_vehicle') AS veh_type, coalesce(zone, 'unknown_zone') AS zone, "
    "coalesce(corridor, 'unknown_corridor') AS corridor, CAST(veh_type IS NULL AS INTEGER) AS veh_type_was_missing, "
    "CAST(zone IS NULL AS INTEGER) AS zone_was_missing, CAST(corridor IS NULL AS INTEGER) AS corridor_was_missing "
    "FROM incidents"))
def imp_02(spark, sf):
    df = incidents(spark, sf).select("id", "veh_type", "zone", "corridor")
    return impute.constant_impute(df, ["veh_type", "zone", "corridor"])


@register("imp_04", O.with_ctes("SELECT id, coalesce(description, '') AS description, coalesce(address, '') AS address "
                                "FROM incidents"))
def imp_04(spark, sf):
    return impute.text_impute(incidents(spark, sf).select("id", "description", "address"), ["description", "address"])


def _missing_sql(c):
    return f"(CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none', 'null') THEN NULL ELSE {c} END)"


_PLACE = (f"coalesce({_missing_sql('junction')}, {_missing_sql('police_station')}, {_missing_sql('corridor')}, "
          f"'City Corridor')")


@register("imp_07", O.with_ctes(
    f"SELECT id, CASE WHEN {O.contains_any('lower(pl)', ['junction', 'bridge', 'cross', 'road', 'circle', 'gate', 'station'])} "
    f"THEN pl ELSE pl || ' Junction' END AS place_name FROM (SELECT id, {_PLACE} AS pl FROM incidents)"))
def imp_07(spark, sf):
    df = incidents(spark, sf).select("id", "junction", "police_station", "corridor")
    return df.select("id", text.place_name("junction", "police_station", "corridor").alias("place_name"))


# ---------------------------------------------------------------- text

from roadlens.functions.text import WS_CLASS as _WS  # noqa: E402


@register("txt_01", O.with_ctes(
    "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[" + _WS + "]+'), lambda x: x <> '')) "
    "AS INTEGER) AS n_words FROM documents"))
def txt_01(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.word_count("text").alias("n_words"))


def _kw_sql(colname, kws, prefix):
    return ", ".join(f"CAST(contains(lower(coalesce({colname}, '')), {O.q(k)}) AS INTEGER) AS "
                     f"{prefix}_has_{k.replace(' ', '_')}" for k in kws)


@register("txt_02", O.with_ctes(
    "SELECT id, CAST(len(list_filter(regexp_split_to_array(coalesce(description, ''), '[" + _WS + "]+'), lambda x: x <> '')) "
    f"AS INTEGER) AS description_len_words, {_kw_sql('description', DESCRIPTION_KEYWORDS, 'description')}, "
    f"{_kw_sql('address', ADDRESS_KEYWORDS, 'address')} FROM incidents"))
def txt_02(spark, sf):
    df = incidents(spark, sf).select("id", "description", "address")
    return df.select("id", text.word_count("description").alias("description_len_words"),
                     *text.keyword_flags("description", DESCRIPTION_KEYWORDS, "description"),
                     *text.keyword_flags("address", ADDRESS_KEYWORDS, "address"))


@register("txt_03", O.with_ctes(
    "SELECT id, coalesce(nullif(regexp_extract(coalesce(address, ''), 'Pin-(\\d{6})', 1), ''), 'unknown_pin') "
    "AS address_pin_code FROM incidents"))
def txt_03(spark, sf):
    return incidents(spark, sf).select("id", text.pin_code("address").alias("address_pin_code"))


@register("txt_04", O.with_ctes(f"SELECT id, {O.dmap('event_cause', CAUSE_DISPLAY, 'Others')} AS cause_display "
                                "FROM incidents"))
def txt_04(spark, sf):
    return incidents(spark, sf).select("id", text.cause_display("event_cause").alias("cause_display"))


REPORT_CATEGORIES = list(REPORT_CATEGORY_CAUSE) + ["Other"]


@register("txt_05", O.with_ctes(
    f"SELECT id, cat AS category, {O.dmap('cat', REPORT_CATEGORY_CAUSE, 'others')} AS mapped_cause FROM "
    f"(SELECT id, {O.case_pick('id % 7', REPORT_CATEGORIES)} AS cat FROM incidents)"))
def txt_05(spark, sf):
    df = incidents(spark, sf).select("id", pick(F.col("id") % 7, REPORT_CATEGORIES).alias("category"))
    return df.select("id", "category", text.report_cause("category").alias("mapped_cause"))


def _ward_sql():
    from roadlens.constants import WARD_RULES
    lc, ld = "lower(coalesce(event_cause, ''))", "lower(coalesce(description, ''))"
    whens = " ".join(f"WHEN {lc} IN {O.in_list(cs)} OR {O.contains_any(ld, ws)} THEN {O.q(cat)}"
                     for cat, cs, ws in reversed(WARD_RULES))
    return f"CASE {whens} ELSE 'other' END"


@register("txt_06", O.with_ctes(f"SELECT id, {_ward_sql()} AS ward_category FROM incidents"))
def txt_06(spark, sf):
    return incidents(spark, sf).select("id", text.ward_category("event_cause", "description").alias("ward_category"))


def _badge_sql():
    from roadlens.constants import BADGE_DEFAULT, BADGE_RULES
    lc = "lower(coalesce(event_cause, ''))"
    whens = " ".join(f"WHEN {O.contains_any(lc, ws)} THEN {O.q(lab)}" for lab, ws in BADGE_RULES)
    return f"CASE {whens} ELSE {O.q(BADGE_DEFAULT)} END"


@register("txt_07", O.with_ctes(f"SELECT id, {_badge_sql()} AS badge FROM incidents"))
def txt_07(spark, sf):
    return incidents(spark, sf).select("id", text.cause_badge("event_cause").alias("badge"))


def _translate_sql():
    from roadlens.constants import TRANSLATION_RULES
    lt = "lower(text)"
    whens = " ".join(f"WHEN lang = {O.q(lang)} AND {O.contains_any(lt, kws)} THEN {O.q(sent)}"
                     for lang, _, kws, sent in TRANSLATION_RULES)
    return f"CASE WHEN lang = 'en' THEN text {whens} ELSE '[Translated from ' || upper(lang) || ']: ' || text END"


@register("txt_08", O.with_ctes(f"SELECT doc_id, lang, {_translate_sql()} AS translated FROM documents"))
def txt_08(spark, sf):
    from roadlens.operators.score import translate
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", translate("text", "lang").alias("translated"))


def _jzone_sql(expr):
    from roadlens.constants import JUNCTION_ZONES
    return "CASE " + " ".join(f"WHEN contains({expr}, {O.q(k)}) THEN {O.q(z)}" for k, z in JUNCTION_ZONES) + \
        " ELSE 'Unknown Zone' END"


def _planar_sql():
    parts = ", ".join(
        f"{{'d': sqrt(pow(latitude - {O.d(la)}, 2) + pow(longitude - {O.d(lo)}, 2)) * {O.d(111.0)}, 'i': {i}, "
        f"'n': {O.q(n)}}}" for i, (n, la, lo, _) in enumerate(JUNCTIONS))
    return f"list_min([{parts}])"


@register("txt_09", O.with_ctes(
    f"SELECT id, nj.n AS nearest_junction, {_jzone_sql('nj.n')} AS junction_zone FROM "
    f"(SELECT id, {_planar_sql()} AS nj FROM incidents)"))
def txt_09(spark, sf):
    df = incidents(spark, sf).select("id", "latitude", "longitude")
    name, _ = nearest_junction_planar()
    return df.select("id", name.alias("nearest_junction")).select(
        "id", "nearest_junction", text.junction_zone("nearest_junction").alias("junction_zone"))


def _hotspot_sql():
    from roadlens.constants import HOTSPOT_RULES
    lc, ld = "lower(coalesce(event_cause, ''))", "lower(coalesce(description, ''))"
    whens = " ".join(f"WHEN {lc} IN {O.in_list(cs)} OR {O.contains_any(ld, ws)} THEN {O.q(t)}"
                     for t, cs, ws in HOTSPOT_RULES)
    return f"CASE {whens} ELSE 'other' END"


@register("txt_11", O.with_ctes(f"SELECT id, {_hotspot_sql()} AS hotspot_type FROM incidents"))
def txt_11(spark, sf):
    return incidents(spark, sf).select("id", text.hotspot_type("event_cause", "description").alias("hotspot_type"))


# ---------------------------------------------------------------- date / time

def _cyc_sql():
    out = []
    for name, v, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12)):
        out.append(f"coalesce(sin({O.d(TWO_PI)} * {v} / {O.d(float(p))}), 0.0) AS {name}_sin")
        out.append(f"coalesce(cos({O.d(TWO_PI)} * {v} / {O.d(float(p))}), 0.0) AS {name}_cos")
    return ", ".join(out)


@register("dtm_01", O.with_ctes(f"SELECT id, {_cyc_sql()} FROM incidents"))
def dtm_01(spark, sf):
    return incidents(spark, sf).select("id", *temporal.cyclical("ts"))


@register("dtm_02", O.with_ctes(
    "SELECT id, coalesce(hour(ts), -1) AS hour, coalesce(isodow(ts) - 1, -1) AS day_of_week, "
    "coalesce(month(ts), -1) AS month FROM incidents"))
def dtm_02(spark, sf):
    return incidents(spark, sf).select("id", *temporal.calendar_parts("ts"))


@register("dtm_03", O.with_ctes(
    f"SELECT id, {O.flag('isodow(ts) - 1 >= 5')} AS is_weekend, {O.flag('coalesce(hour(ts), -1) BETWEEN 4 AND 7')} "
    f"AS is_morning_peak, {O.flag('coalesce(hour(ts), -1) BETWEEN 19 AND 23')} AS is_night_peak FROM incidents"))
def dtm_03(spark, sf):
    return incidents(spark, sf).select("id", *temporal.peak_flags("ts"))


@register("dtm_04", O.with_ctes(
    "SELECT id, coalesce(CAST(epoch_us(created_ts) - epoch_us(ts) AS DOUBLE) / 6e7, -1.0) AS reporting_lag_min "
    "FROM incidents"))
def dtm_04(spark, sf):
    return incidents(spark, sf).select("id", temporal.lag_minutes("ts", "created_ts").alias("reporting_lag_min"))


_HB_LABEL_SQL = ("CASE WHEN h BETWEEN 0 AND 3 THEN 'deep_night' WHEN h BETWEEN 4 AND 7 THEN 'early_morn' "
                 "WHEN h BETWEEN 8 AND 13 THEN 'daytime' WHEN h BETWEEN 14 AND 18 THEN 'afternoon' "
                 "WHEN h BETWEEN 19 AND 23 THEN 'evening' ELSE 'unknown' END")


@register("dtm_05", O.with_ctes(
    f"SELECT id, {_HB_LABEL_SQL} AS hour_bin_label, {O.hour_bin_code_sql('h')} AS hour_bin_code FROM "
    "(SELECT id, coalesce(hour(ts), -1) AS h FROM incidents)"))
def dtm_05(spark, sf):
    h = temporal.hour_of("ts")
    return incidents(spark, sf).select("id", temporal.hour_bin_label(h).alias("hour_bin_label"),
                                       temporal.hour_bin_code(h).alias("hour_bin_code"))


@register("dtm_06", O.with_ctes(
    f"SELECT id, {O.flag('h BETWEEN 8 AND 19')} AS is_daytime_ban_window, {O.flag('h IN (7, 8, 19, 20)')} "
    f"AS is_transition_hour, {O.flag('h BETWEEN 2 AND 4')} AS is_pre_dawn FROM "
    "(SELECT id, coalesce(hour(ts), -1) AS h FROM incidents)"))
def dtm_06(spark, sf):
    return incidents(spark, sf).select("id", *temporal.ban_flags(temporal.hour_of("ts")))


@register("dtm_07", O.with_ctes(
    "SELECT id, CAST(least(greatest(floor(coalesce(hour(ts), -1) / 6), 0), 3) AS INTEGER) AS hour_quadrant "
    "FROM incidents"))
def dtm_07(spark, sf):
    return incidents(spark, sf).select("id", temporal.hour_quadrant(temporal.hour_of("ts")).alias("hour_quadrant"))


@register("dtm_08", O.with_ctes(
    f"SELECT id, {O.flag('coalesce(dayofmonth(ts), 15) >= 28')} AS is_month_end, "
    "CAST(floor((coalesce(month(ts), 1) - 1) / 3) + 1 AS INTEGER) AS quarter FROM incidents"))
def dtm_08(spark, sf):
    return incidents(spark, sf).select("id", *temporal.month_end_quarter("ts"))


@register("dtm_09", O.with_ctes(
    "SELECT id, coalesce(round_even(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2023-11-09 00:00:00') AS DOUBLE) "
    "/ 86400e6, 3), -1.0) AS days_since_epoch FROM incidents"))
def dtm_09(spark, sf):
    return incidents(spark, sf).select("id", temporal.days_since_epoch("ts").alias("days_since_epoch"))


@register("dtm_10", O.with_ctes(
    f"SELECT id, coalesce(m, -1) AS time_since_midnight_min, "
    f"round_even(sin({O.d(TWO_PI)} * CAST(coalesce(m, 0) AS DOUBLE) / 1440.0), 6) AS sin_hour_fine, "
    f"round_even(cos({O.d(TWO_PI)} * CAST(coalesce(m, 0) AS DOUBLE) / 1440.0), 6) AS cos_hour_fine FROM "
    "(SELECT id, hour(ts) * 60 + minute(ts) AS m FROM incidents)"))
def dtm_10(spark, sf):
    return incidents(spark, sf).select("id", *temporal.minutes_of_day("ts"))


@register("dtm_11", O.with_ctes("""
SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago'
  WHEN floor(m / 60) < 24 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR) || 'h ago'
  ELSE CAST(CAST(floor(floor(m / 60) / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age
FROM (SELECT id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS m
      FROM incidents WHERE ts IS NOT NULL)"""))
def dtm_11(spark, sf):
    df = incidents(spark, sf).filter(F.col("ts").isNotNull())
    return df.select("id", temporal.relative_age("ts", F.to_timestamp(F.lit("2024-01-31 00:00:00"))).alias("age"))


@register("dtm_12", O.with_ctes(
    "SELECT id, CASE WHEN e - s < 0 THEN e - s + 1440 ELSE e - s END AS duration_min FROM "
    "(SELECT id, hour(ts) * 60 + minute(ts) AS s, CAST((hour(ts) * 60 + minute(ts) + CAST(floor(duration_mins) AS BIGINT)) "
    "% 1440 AS BIGINT) AS e FROM incidents WHERE ts IS NOT NULL)"))
def dtm_12(spark, sf):
    df = incidents(spark, sf).filter(F.col("ts").isNotNull())
    s = F.hour("ts") * 60 + F.minute("ts")
    e = ((s + F.floor("duration_mins").cast("long")) % 1440).cast("long")
    return df.select("id", temporal.duration_rollover(s, e).alias("duration_min"))


# ---------------------------------------------------------------- geospatial

@register("geo_01", O.with_ctes(
    f"SELECT id, {O.hav('latitude', 'longitude', 12.9716, 77.5946)} AS km_to_centre FROM incidents"))
def geo_01(spark, sf):
    return incidents(spark, sf).select("id", geo.haversine_km("latitude", "longitude", *CITY_CENTRE)
                                       .alias("km_to_centre"))


@register("geo_02", O.with_ctes(
    "SELECT id, " + ", ".join(f"round_even({O.hav('latitude', 'longitude', la, lo)}, 4) AS dist_to_{n}"
                              for n, la, lo in RISK_JUNCTIONS) + " FROM incidents"))
def geo_02(spark, sf):
    return incidents(spark, sf).select("id", *geo.anchor_distances())


_NEAR_SQL = "list_min([" + ", ".join(
    f"{{'d': {O.hav('latitude', 'longitude', la, lo)}, 'i': {i}}}" for i, (_, la, lo) in enumerate(RISK_JUNCTIONS)) + "])"


@register("geo_03", O.with_ctes(
    f"SELECT id, round_even(nn.d, 4) AS dist_to_nearest_junction, nn.i AS nearest_junction_idx FROM "
    f"(SELECT id, {_NEAR_SQL} AS nn FROM incidents)"))
def geo_03(spark, sf):
    return incidents(spark, sf).select("id", *geo.nearest_anchor())


def _station_sql():
    def atan_km(la, lo):
        a = (f"(pow(sin(radians({O.d(la)} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({O.d(la)})) "
             f"* pow(sin(radians({O.d(lo)} - longitude) / 2), 2))")
        return f"round_even({O.d(6371.0)} * (2 * atan2(sqrt({a}), sqrt(1 - {a}))), 2)"
    parts = ", ".join(f"{{'d': {atan_km(la, lo)}, 'i': {i}, 'n': {O.q(n)}}}"
                      for i, (n, la, lo) in enumerate(POLICE_STATIONS))
    return f"list_min([{parts}])"


@register("geo_04", O.with_ctes(
    f"SELECT id, ns.n AS nearest_station, ns.d AS station_km FROM (SELECT id, {_station_sql()} AS ns FROM incidents)"))
def geo_04(spark, sf):
    from roadlens.operators.score import nearest_station
    name, km = nearest_station("latitude", "longitude")
    return incidents(spark, sf).select("id", name.alias("nearest_station"), km.alias("station_km"))


@register("geo_05", O.with_ctes(
    f"SELECT id, CASE WHEN nj.d < 999.0 THEN nj.n ELSE 'City Centre' END AS nearest_junction, "
    f"round_even(least(nj.d, 999.0), 6) AS nearest_junction_dist_km FROM (SELECT id, {_planar_sql()} AS nj FROM incidents)"))
def geo_05(spark, sf):
    name, dist = nearest_junction_planar()
    return incidents(spark, sf).select("id", name.alias("nearest_junction"),
                                       np_round(dist, 6).alias("nearest_junction_dist_km"))


@register("geo_06", O.with_ctes(
    f"SELECT id, round_even({O.hav('latitude', 'longitude', *CITY_CENTRE)}, 3) AS dist_to_city_centre, "
    f"round_even({O.hav('latitude', 'longitude', *AIRPORT)}, 3) AS dist_to_airport FROM incidents"))
def geo_06(spark, sf):
    return incidents(spark, sf).select("id", *geo.city_distances())


@register("geo_07", O.with_ctes(
    "SELECT id, CASE WHEN dcc <= 5 THEN 0 WHEN dcc <= 10 THEN 1 WHEN dcc <= 15 THEN 2 WHEN dcc <= 20 THEN 3 ELSE 4 END "
    f"AS radial_band FROM (SELECT id, round_even({O.hav('latitude', 'longitude', *CITY_CENTRE)}, 3) AS dcc FROM incidents)"))
def geo_07(spark, sf):
    df = incidents(spark, sf).select("id", *geo.city_distances())
    return df.select("id", geo.radial_band("dist_to_city_centre").alias("radial_band"))


@register("geo_08", O.with_ctes(
    "SELECT id, CAST(trunc(latitude / 0.01) AS INTEGER) AS lat_grid_cell, CAST(trunc(longitude / 0.01) AS INTEGER) "
    "AS lon_grid_cell, CAST(CAST(trunc(latitude / 0.01) AS INTEGER) AS VARCHAR) || '_' || "
    "CAST(CAST(trunc(longitude / 0.01) AS INTEGER) AS VARCHAR) AS spatial_grid_id FROM incidents"))
def geo_08(spark, sf):
    return incidents(spark, sf).select("id", *geo.grid_cells())


@register("geo_09", O.with_ctes("SELECT id, round_even(latitude * longitude, 6) AS lat_lon_product FROM incidents"))
def geo_09(spark, sf):
    return incidents(spark, sf).select("id", geo.lat_lon_product().alias("lat_lon_product"))


@register("geo_10", O.with_ctes("""
SELECT CAST(floor(latitude / 0.02) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.02) AS BIGINT) AS cell_lon,
       round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon, count(*) AS n_incidents,
       max(CASE WHEN priority = 'High' THEN 3 ELSE 1 END) AS max_risk_weight
FROM incidents GROUP BY 1, 2"""))
def geo_10(spark, sf):
    from roadlens.operators.dashboards import grid_clusters
    df = incidents(spark, sf).select("latitude", "longitude",
                                     F.when(F.col("priority") == "High", 3).otherwise(1).alias("risk_weight"))
    return grid_clusters(df, zoom=12)


@register("geo_11", O.with_ctes(f"""
SELECT cell_lat, cell_lon, round(sum(w), 6) AS heat, count(*) AS n_contrib FROM (
  SELECT cell_lat, cell_lon,
         (CASE WHEN dk <= 0.12 THEN {O.d(0.22)} ELSE {O.d(0.0)} END + CASE WHEN dk <= 0.4 THEN {O.d(0.07)} ELSE {O.d(0.0)} END
          + CASE WHEN dk <= 0.8 THEN {O.d(0.03)} ELSE {O.d(0.0)} END) AS w
  FROM (SELECT cl AS cell_lat, cn AS cell_lon,
               {O.hav('latitude', 'longitude', '((CAST(cl AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.01 AS DOUBLE))', '((CAST(cn AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.01 AS DOUBLE))')} AS dk
        FROM (SELECT latitude, longitude, CAST(floor(latitude / 0.01) AS BIGINT) + dl AS cl,
                     CAST(floor(longitude / 0.01) AS BIGINT) + dn AS cn
              FROM incidents, (SELECT unnest([-1, 0, 1]) AS dl), (SELECT unnest([-1, 0, 1]) AS dn))))
WHERE w > 0 GROUP BY 1, 2"""))
def geo_11(spark, sf):
    from roadlens.operators.dashboards import heat_surface
    return heat_surface(incidents(spark, sf).select("latitude", "longitude"))


# ---------------------------------------------------------------- event features

_PLANNED = "event_type = 'planned'"


def _sev_sql(c="event_cause"):
    return f"round_even({O.dmap(c, CAUSE_SEVERITY, 0.083)}, 4)"


@register("evt_01", O.with_ctes(
    f"SELECT id, {_sev_sql()} AS cause_severity_score, round_even({O.dmap('event_cause', CAUSE_PRIORITY, 0.598)}, 4) "
    "AS cause_priority_score FROM incidents"))
def evt_01(spark, sf):
    return incidents(spark, sf).select("id", *events.cause_scores())


_CATS = [("infrastructure", "is_infrastructure"), ("obstruction", "is_obstruction"), ("vehicle", "is_vehicle_incident"),
         ("social", "is_social_event"), ("environmental", "is_environmental")]


@register("evt_02", O.with_ctes(
    "SELECT id, cc AS cause_category, " + ", ".join(f"CAST(cc = {O.q(c)} AS INTEGER) AS {n}" for c, n in _CATS)
    + f" FROM (SELECT id, {O.dmap('event_cause', CAUSE_CATEGORY, 'other')} AS cc FROM incidents)"))
def evt_02(spark, sf):
    df = incidents(spark, sf).select("id", events.cause_category().alias("cause_category"))
    return df.select("id", "cause_category", *events.category_flags())


@register("evt_03", O.with_ctes(
    f"SELECT id, {O.flag(_sev_sql() + ' >= 0.25')} AS is_high_closure_risk, {O.flag(_PLANNED)} "
    "AS is_planned_event FROM incidents"))
def evt_03(spark, sf):
    df = incidents(spark, sf).select("id", "event_type", *events.cause_scores())
    return df.select("id", events.high_closure_flag().alias("is_high_closure_risk"),
                     events.planned_flag().alias("is_planned_event"))


@register("evt_04", O.with_ctes(
    f"SELECT id, round_even({O.dmap('veh_type', VEHICLE_RISK, 0.044)}, 4) AS veh_type_risk_score, "
    f"{O.flag('veh_type IN ' + O.in_list(HEAVY_VEHICLES))} AS is_heavy_vehicle, "
    f"{O.flag('veh_type IN ' + O.in_list(PUBLIC_TRANSPORT))} AS is_public_transport FROM incidents"))
def evt_04(spark, sf):
    return incidents(spark, sf).select("id", *events.vehicle_features())


def _corr_flags_sql():
    from roadlens.constants import ARTERIAL_CORRIDORS, CBD_CORRIDORS
    return (f"{O.flag('corridor IN ' + O.in_list(ARTERIAL_CORRIDORS))} AS is_arterial_corridor, "
            f"{O.flag(chr(39).join(['corridor = ', 'Non-corridor', '']))} AS is_non_corridor, "
            f"{O.flag('corridor IN ' + O.in_list(CBD_CORRIDORS))} AS is_cbd_corridor")


@register("evt_05", O.with_ctes(f"SELECT id, {_corr_flags_sql()} FROM incidents"))
def evt_05(spark, sf):
    return incidents(spark, sf).select("id", *events.corridor_flags())


def _route_sql():
    from roadlens.constants import ORBITAL_CORRIDORS, RADIAL_CORRIDORS
    c = "coalesce(corridor, 'nan')"
    r, o = f"{c} IN {O.in_list(RADIAL_CORRIDORS)}", f"{c} IN {O.in_list(ORBITAL_CORRIDORS)}"
    cbd, non = f"{c} IN ('CBD 1', 'CBD 2')", f"{c} = 'Non-corridor'"
    return (f"CAST({r} AS INTEGER) AS is_radial_route, CAST({o} AS INTEGER) AS is_orbital_route, "
            f"CASE WHEN {r} THEN 0 WHEN {o} THEN 1 WHEN {cbd} THEN 2 WHEN {non} THEN 3 ELSE 4 END AS corridor_cluster, "
            f"CASE WHEN {o} THEN 2 WHEN {r} THEN 1 WHEN {cbd} OR {non} THEN 0 ELSE 1 END AS corridor_length_proxy")


@register("evt_06", O.with_ctes(f"SELECT id, {_route_sql()} FROM incidents"))
def evt_06(spark, sf):
    return incidents(spark, sf).select("id", *events.route_features(F.coalesce(F.col("corridor"), F.lit("nan"))))


@register("evt_07", O.with_ctes(
    f"SELECT id, ({O.flag('coalesce(hour(ts), -1) BETWEEN 19 AND 23')} | {O.flag('coalesce(hour(ts), -1) BETWEEN 4 AND 7')}) "
    f"& {O.flag(chr(39).join(['event_cause IN (', 'vehicle_breakdown', ', ', 'construction', ', ', 'road_conditions', ', ', 'pot_holes', ')']))} "
    "AS is_peak_congestion FROM incidents"))
def evt_07(spark, sf):
    df = incidents(spark, sf).select("id", "event_cause", *temporal.peak_flags("ts"))
    return df.select("id", events.peak_congestion())


@register("evt_08", O.with_ctes(
    "SELECT id, CAST(coalesce(zone, 'unknown_zone') = 'unknown_zone' AS INTEGER) AS is_unknown_zone, "
    "CAST(NOT (coalesce(junction, 'unknown_junction') IN ('unknown_junction', 'nan')) AS INTEGER) AS is_known_junction "
    "FROM incidents"))
def evt_08(spark, sf):
    df = impute.constant_impute(incidents(spark, sf).select("id", "zone", "junction"), ["zone", "junction"],
                                add_indicator=False)
    return df.select("id", *events.place_flags())

