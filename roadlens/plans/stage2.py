"""INT-03: full stage-2 feature assembly in dependency order
(temporal -> event -> congestion -> zone/junction/geo -> interactions -> rolling).

Fit statistics come from one pass over a slim projection of the training rows,
so the fact table is scanned once for fitting and once for transforming, no
matter how many statistic tables there are; every statistics table is an
aggregate joined back, broadcast when its counted bytes allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.constants import CAUSE_CATEGORY, CAUSE_PRIORITY, CAUSE_SEVERITY, VEHICLE_RISK
from roadlens.functions import geo, temporal
from roadlens.functions.common import flag, np_round
from roadlens.operators import events, rates, rolling, statsbank
from roadlens.operators import features as feat
from roadlens.plans import oracle_base as O
from roadlens.sources.tables import incidents

T = "requires_road_closure"
INTERACTION_COLS = ["cause_x_peak", "cause_x_weekend", "cause_x_arterial", "cause_x_zone_risk", "heavy_x_night",
                    "heavy_x_arterial", "obstruction_x_daytime", "social_x_weekend", "zone_risk_x_hour",
                    "dist_centre_x_severity", "corridor_x_peak_load", "junction_x_severity"]
_TRAIN_COLS = ["id", "ts", "event_cause", "corridor", "zone", "gba_identifier", "junction", "police_station",
               "hour", "hour_bin_code", T]


def assemble_frame(ctx: DataFrame, train: DataFrame, prior: float) -> DataFrame:
    """Stage-2 features for ``ctx`` rows (prepared context) fitted on ``train``."""
    t = ctx.select(
        "id", "ts", "event_cause", "event_type", "veh_type", "corridor", "zone", "gba_identifier", "junction",
        "police_station", "latitude", "longitude", "hour", "hour_bin_code",
        F.coalesce(F.weekday("ts"), F.lit(-1)).alias("day_of_week"),
        *temporal.peak_flags("ts"), *temporal.ban_flags("hour"),
        temporal.hour_quadrant("hour").alias("hour_quadrant"), *temporal.month_end_quarter("ts"),
        temporal.days_since_epoch("ts").alias("days_since_epoch"),
        temporal.minutes_of_day("ts")[0],
    )
    e = events.event_features(t)
    e = e.select("*", *events.corridor_flags(), events.peak_congestion(), *events.place_flags(),
                 *events.route_features(), *geo.city_distances(), *geo.grid_cells(),
                 geo.lat_lon_product().alias("lat_lon_product"))
    e = e.withColumn("radial_band", geo.radial_band("dist_to_city_centre"))
    tr = train.select(*_TRAIN_COLS, F.to_date("ts").cast("string").alias("__date"))
    e = e.withColumn("__date", F.to_date("ts").cast("string"))
    # range counts first, on the plain projection of the scan: the probe side and the
    # join back then re-read only the scan, not the lookup joins added below
    e = rolling.window_counts(e, tr, [3, 6])
    x = apply_bank(e, tr, prior)
    x = feat.interactions(x, prior)
    return x.drop("ts", "__date", "hour_closure_rate_raw", "latitude", "longitude", "event_cause", "event_type",
                  "veh_type", "corridor", "zone", "gba_identifier", "junction", "police_station")


FAMILIES = {
    "corridor": ["corridor"], "corridor_hb": ["corridor", "hour_bin_code"], "hb": ["hour_bin_code"],
    "police": ["police_station"], "zone": ["zone"], "gba": ["gba_identifier"], "junction": ["junction"],
    "hour": ["hour"], "pair_corridor_zone": ["corridor", "zone"], "pair_hb_cause": ["hour_bin_code", "event_cause"],
    "pair_zone_cause": ["zone", "event_cause"], "pair_police_hb": ["police_station", "hour_bin_code"],
    "day": ["__date"], "zone_day": ["zone", "__date"],
}


def apply_bank(e: DataFrame, tr: DataFrame, prior: float) -> DataFrame:
    """All group-rate / density / rank / same-day features from one statistics pass."""
    bank = statsbank.fit_bank(tr, FAMILIES, {
        "y": F.col(T).cast("double"), "veh": (F.col("event_cause") == "vehicle_breakdown").cast("double")})
    n_all, n_zone = float(bank["hb"].totals["n"]), float(bank["zone"].totals["n"])

    def smooth(alpha, min_count=0):
        return statsbank.smoothed(alpha, prior, min_count)

    def share(total):
        return F.col("n") / F.lit(total)

    def col_of(name, default, digits=None):
        c = F.coalesce(F.col(name), F.lit(default))
        return np_round(c, digits) if digits is not None else c

    count = F.col("n").cast("double")
    x = e
    x = statsbank.apply(x, bank["corridor"], {"__cr": smooth(20, 20), "__cd": share(n_all), "__vf": F.col("veh") / F.col("n")})
    x = statsbank.apply(x, bank["corridor_hb"], {"__hc": share(n_all)})
    x = statsbank.apply(x, bank["hb"], {"__hl": share(n_all)})
    x = statsbank.apply(x, bank["police"], {"__ps": smooth(10)})
    x = statsbank.apply(x, bank["zone"], {"__zr": smooth(10), "__zd": share(n_zone)})
    x = statsbank.apply(x, bank["gba"], {"__gb": smooth(10)})
    x = statsbank.apply(x, statsbank.ranked(bank["junction"], "rank"),
                        {"__jr": smooth(10, 10), "__jc": count, "__jk": F.col("rank")})
    x = statsbank.apply(x, bank["hour"], {"__hr": F.col("y") / F.col("n")})
    pairs = {}
    for fam, (_, name) in zip(["pair_corridor_zone", "pair_hb_cause", "pair_zone_cause", "pair_police_hb"], feat.PAIR_RATES):
        x = statsbank.apply(x, bank[fam], {f"__{name}": smooth(10, 5)})
        pairs[name] = f"__{name}"
    x = statsbank.apply(x, bank["day"], {"__sd": count})
    x = statsbank.apply(x, bank["zone_day"], {"__szd": count})
    jr = col_of("__jr", prior, 4)
    zr = col_of("__zr", prior, 4)
    hr_raw = col_of("__hr", prior)
    out = x.select(
        *[c for c in e.columns],
        col_of("__cr", prior, 4).alias("corridor_risk_score"), col_of("__cd", 0.0, 5).alias("corridor_event_density"),
        col_of("__vf", 0.5, 4).alias("vehicles_per_corridor"), col_of("__hc", 0.0).alias("hour_corridor_density"),
        col_of("__hl", 0.2, 5).alias("hour_bin_system_load"), col_of("__ps", prior, 4).alias("police_station_risk"),
        zr.alias("zone_risk_score"), col_of("__zd", 0.0, 5).alias("zone_event_density"),
        flag(zr >= feat.HIGH_RISK_ZONE).alias("is_high_risk_zone"), col_of("__gb", prior, 4).alias("gba_risk_score"),
        jr.alias("junction_closure_rate"), col_of("__jc", 0.0).cast("int").alias("junction_event_count"),
        col_of("__jk", 999.0).cast("int").alias("junction_hotspot_rank"),
        np_round(F.lit(1.0) - jr, 4).alias("junction_safety_index"),
        hr_raw.alias("hour_closure_rate_raw"), np_round(hr_raw, 4).alias("hour_closure_risk"),
        *[col_of(c, prior).alias(name) for name, c in pairs.items()],
        col_of("__sd", 0.0).cast("long").alias("events_same_day"),
        col_of("__szd", 0.0).cast("long").alias("events_same_zone_day"))
    return out.withColumn("closure_risk_composite", feat.composite_risk())


def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = feat.prepare_context(incidents(spark, sf_dir))
    train = ctx.filter(F.col("is_train"))
    prior = rates.global_mean(train, T)
    return assemble_frame(ctx, train, prior)


# ---------------------------------------------------------------- DuckDB twin

def _roll(hours):
    return (f"CASE WHEN p.ts IS NULL THEN 0 ELSE (SELECT count(*) FROM tr t WHERE epoch_us(t.ts) >= epoch_us(p.ts) - "
            f"{hours * 3600 * 1000000} AND epoch_us(t.ts) < epoch_us(p.ts)) END")


def _base_sql():
    from roadlens.constants import (ARTERIAL_CORRIDORS, HEAVY_VEHICLES, ORBITAL_CORRIDORS,
                                    PUBLIC_TRANSPORT, RADIAL_CORRIDORS, CITY_CENTRE, AIRPORT)
    sev = f"round_even({O.dmap('event_cause', CAUSE_SEVERITY, 0.083)}, 4)"
    cat = O.dmap("event_cause", CAUSE_CATEGORY, "other")
    r, o = f"corridor IN {O.in_list(RADIAL_CORRIDORS)}", f"corridor IN {O.in_list(ORBITAL_CORRIDORS)}"
    cbd, non = "corridor IN ('CBD 1', 'CBD 2')", "corridor = 'Non-corridor'"
    dcc = f"round_even({O.hav('latitude', 'longitude', *CITY_CENTRE)}, 3)"
    return f"""
SELECT id, ts, event_cause, corridor, zone, gba_identifier, junction, police_station, hour, hour_bin_code, is_train,
  coalesce(isodow(ts) - 1, -1) AS day_of_week,
  {O.flag('isodow(ts) - 1 >= 5')} AS is_weekend, {O.flag('hour BETWEEN 4 AND 7')} AS is_morning_peak,
  {O.flag('hour BETWEEN 19 AND 23')} AS is_night_peak,
  {O.flag('hour BETWEEN 8 AND 19')} AS is_daytime_ban_window, {O.flag('hour IN (7, 8, 19, 20)')} AS is_transition_hour,
  {O.flag('hour BETWEEN 2 AND 4')} AS is_pre_dawn,
  CAST(least(greatest(floor(hour / 6), 0), 3) AS INTEGER) AS hour_quadrant,
  {O.flag('coalesce(dayofmonth(ts), 15) >= 28')} AS is_month_end,
  CAST(floor((coalesce(month(ts), 1) - 1) / 3) + 1 AS INTEGER) AS quarter,
  coalesce(round_even(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2023-11-09 00:00:00') AS DOUBLE) / 86400e6, 3), -1.0) AS days_since_epoch,
  coalesce(hour(ts) * 60 + minute(ts), -1) AS time_since_midnight_min,
  {sev} AS cause_severity_score,
  round_even({O.dmap('event_cause', CAUSE_PRIORITY, 0.598)}, 4) AS cause_priority_score,
  {cat} AS cause_category,
  CAST({cat} = 'infrastructure' AS INTEGER) AS is_infrastructure, CAST({cat} = 'obstruction' AS INTEGER) AS is_obstruction,
  CAST({cat} = 'vehicle' AS INTEGER) AS is_vehicle_incident, CAST({cat} = 'social' AS INTEGER) AS is_social_event,
  CAST({cat} = 'environmental' AS INTEGER) AS is_environmental,
  {O.flag(sev + ' >= 0.25')} AS is_high_closure_risk, {O.flag("event_type = 'planned'")} AS is_planned_event,
  round_even({O.dmap('veh_type', VEHICLE_RISK, 0.044)}, 4) AS veh_type_risk_score,
  {O.flag('veh_type IN ' + O.in_list(HEAVY_VEHICLES))} AS is_heavy_vehicle,
  {O.flag('veh_type IN ' + O.in_list(PUBLIC_TRANSPORT))} AS is_public_transport,
  {O.flag('corridor IN ' + O.in_list(ARTERIAL_CORRIDORS))} AS is_arterial_corridor,
  {O.flag(non)} AS is_non_corridor, {O.flag(cbd)} AS is_cbd_corridor,
  ({O.flag('hour BETWEEN 19 AND 23')} | {O.flag('hour BETWEEN 4 AND 7')})
     & {O.flag("event_cause IN ('vehicle_breakdown', 'construction', 'road_conditions', 'pot_holes')")} AS is_peak_congestion,
  CAST(zone = 'unknown_zone' AS INTEGER) AS is_unknown_zone,
  CAST(NOT (junction IN ('unknown_junction', 'nan')) AS INTEGER) AS is_known_junction,
  CAST({r} AS INTEGER) AS is_radial_route, CAST({o} AS INTEGER) AS is_orbital_route,
  CASE WHEN {r} THEN 0 WHEN {o} THEN 1 WHEN {cbd} THEN 2 WHEN {non} THEN 3 ELSE 4 END AS corridor_cluster,
  CASE WHEN {o} THEN 2 WHEN {r} THEN 1 WHEN {cbd} OR {non} THEN 0 ELSE 1 END AS corridor_length_proxy,
  {dcc} AS dist_to_city_centre,
  round_even({O.hav('latitude', 'longitude', *AIRPORT)}, 3) AS dist_to_airport,
  CAST(trunc(latitude / 0.01) AS INTEGER) AS lat_grid_cell, CAST(trunc(longitude / 0.01) AS INTEGER) AS lon_grid_cell,
  CAST(CAST(trunc(latitude / 0.01) AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(trunc(longitude / 0.01) AS INTEGER) AS VARCHAR) AS spatial_grid_id,
  round_even(latitude * longitude, 6) AS lat_lon_product,
  CASE WHEN {dcc} <= 5 THEN 0 WHEN {dcc} <= 10 THEN 1 WHEN {dcc} <= 15 THEN 2 WHEN {dcc} <= 20 THEN 3 ELSE 4 END AS radial_band
FROM prep"""


def _features_sql():
    pr = [f"{O.smoothed(f'pr{i}', 10, 5)} AS {name}" for i, (_, name) in enumerate(feat.PAIR_RATES)]
    prj = " ".join(f"LEFT JOIN pr{i} ON {O.join_on(f'pr{i}', keys)}" for i, (keys, _) in enumerate(feat.PAIR_RATES))
    return f"""
SELECT p.*,
  round_even({O.smoothed('cr', 20, 20)}, 4) AS corridor_risk_score,
  round_even(coalesce(cd.n / (SELECT count(*) FROM tr), 0.0), 5) AS corridor_event_density,
  round_even(coalesce(vf.m, 0.5), 4) AS vehicles_per_corridor,
  coalesce(hc.n / (SELECT count(*) FROM tr), 0.0) AS hour_corridor_density,
  round_even(coalesce(hl.n / (SELECT count(*) FROM tr), 0.2), 5) AS hour_bin_system_load,
  round_even({O.smoothed('ps', 10)}, 4) AS police_station_risk,
  round_even({O.smoothed('zr', 10)}, 4) AS zone_risk_score,
  round_even(coalesce(zd.n / (SELECT count(zone) FROM tr), 0.0), 5) AS zone_event_density,
  round_even({O.smoothed('gb', 10)}, 4) AS gba_risk_score,
  round_even({O.smoothed('jr', 10, 10)}, 4) AS junction_closure_rate,
  CAST(coalesce(jr.n, 0) AS INTEGER) AS junction_event_count,
  CAST(coalesce(jk.rk, 999) AS INTEGER) AS junction_hotspot_rank,
  coalesce(hr.m, g.gm) AS hour_raw,
  {", ".join(pr)},
  {_roll(3)} AS rolling_3h_system_count, {_roll(6)} AS rolling_6h_system_count,
  coalesce(sd.n, 0) AS events_same_day, coalesce(szd.n, 0) AS events_same_zone_day
FROM base p CROSS JOIN g
LEFT JOIN cr ON p.corridor = cr.corridor LEFT JOIN cd ON p.corridor = cd.corridor
LEFT JOIN vf ON p.corridor = vf.corridor
LEFT JOIN hc ON p.corridor = hc.corridor AND p.hour_bin_code = hc.hour_bin_code
LEFT JOIN hl ON p.hour_bin_code = hl.hour_bin_code LEFT JOIN ps ON p.police_station = ps.police_station
LEFT JOIN zr ON p.zone = zr.zone LEFT JOIN zd ON p.zone = zd.zone LEFT JOIN gb ON p.gba_identifier = gb.gba_identifier
LEFT JOIN jr ON p.junction = jr.junction LEFT JOIN jk ON p.junction = jk.junction LEFT JOIN hr ON p.hour = hr.hour
{prj}
LEFT JOIN sd ON CAST(p.ts AS DATE) = sd.d LEFT JOIN szd ON CAST(p.ts AS DATE) = szd.d AND p.zone = szd.zone"""


def _final_sql():
    g = "g.gm"
    return f"""
SELECT * EXCLUDE (ts, event_cause, corridor, zone, gba_identifier, junction, police_station, hour_raw, is_train),
  round_even(hour_raw, 4) AS hour_closure_risk,
  CAST(round_even(1.0 - junction_closure_rate, 4) AS DOUBLE) AS junction_safety_index,
  CAST(zone_risk_score >= 0.10 AS INTEGER) AS is_high_risk_zone,
  round_even(0.40 * cause_severity_score + 0.25 * zone_risk_score + 0.20 * corridor_risk_score + 0.15 * hour_raw, 4)
    AS closure_risk_composite,
  round_even(cause_severity_score * is_night_peak, 4) AS cause_x_peak,
  round_even(cause_severity_score * is_weekend, 4) AS cause_x_weekend,
  round_even(cause_severity_score * is_arterial_corridor, 4) AS cause_x_arterial,
  round_even(cause_severity_score * zone_risk_score, 4) AS cause_x_zone_risk,
  CAST(is_heavy_vehicle * is_night_peak AS INTEGER) AS heavy_x_night,
  CAST(is_heavy_vehicle * is_arterial_corridor AS INTEGER) AS heavy_x_arterial,
  CAST(is_obstruction * is_daytime_ban_window AS INTEGER) AS obstruction_x_daytime,
  CAST(is_social_event * is_weekend AS INTEGER) AS social_x_weekend,
  round_even(zone_risk_score * round_even(hour_raw, 4), 4) AS zone_risk_x_hour,
  round_even(dist_to_city_centre * cause_severity_score, 4) AS dist_centre_x_severity,
  round_even(corridor_risk_score * hour_bin_system_load, 6) AS corridor_x_peak_load,
  round_even(junction_closure_rate * cause_severity_score, 4) AS junction_x_severity
FROM f CROSS JOIN (SELECT gm AS _g FROM g) gg"""


def STAGE2_SQL(body: str) -> str:
    pairs = {f"pr{i}": O.rate_cte(keys) for i, (keys, _) in enumerate(feat.PAIR_RATES)}
    return O.with_prep(
        body,
        base=_base_sql(),
        cr=O.rate_cte(["corridor"]), cd="SELECT corridor, count(*) AS n FROM tr WHERE corridor IS NOT NULL GROUP BY 1",
        vf="SELECT corridor, avg(CASE WHEN event_cause = 'vehicle_breakdown' THEN 1.0 ELSE 0.0 END) AS m FROM tr "
           "WHERE corridor IS NOT NULL GROUP BY 1",
        hc="SELECT corridor, hour_bin_code, count(*) AS n FROM tr GROUP BY ALL",
        hl="SELECT hour_bin_code, count(*) AS n FROM tr GROUP BY ALL",
        ps=O.rate_cte(["police_station"]), zr=O.rate_cte(["zone"]),
        zd="SELECT zone, count(*) AS n FROM tr WHERE zone IS NOT NULL GROUP BY 1",
        gb=O.rate_cte(["gba_identifier"]), jr=O.rate_cte(["junction"]),
        jk="SELECT junction, row_number() OVER (ORDER BY n DESC, junction) AS rk FROM "
           "(SELECT junction, count(*) AS n FROM tr WHERE junction IS NOT NULL GROUP BY junction)",
        hr=O.rate_cte(["hour"]), **pairs,
        sd="SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM tr WHERE ts IS NOT NULL GROUP BY 1",
        szd="SELECT zone, CAST(ts AS DATE) AS d, count(*) AS n FROM tr WHERE ts IS NOT NULL GROUP BY 1, 2",
        f=_features_sql(), s2=_final_sql().replace("g.gm", "_g"))
