"""Grouped statistics with lookup (GRP-01..13), interactions (INT-01..03).

Every feature family is *fit* on training rows as a small statistics table and
*applied* with ``rates.lookup`` (left join + default).  Keys are always the raw
(imputed) strings, never encoded floats (SURVEY Q4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.common import col, flag, np_round
from roadlens.functions.temporal import hour_bin_code, hour_of
from roadlens.operators import rates
from roadlens.operators.prefix import global_positions

HIGH_RISK_ZONE = 0.10


def prepare_context(df: DataFrame, ts="ts") -> DataFrame:
    """Keys used by stage 2: imputed categoricals + hour + hour bin code."""
    fills = {"veh_type": "unknown_vehicle", "gba_identifier": "unknown_gba", "zone": "unknown_zone",
             "junction": "unknown_junction", "corridor": "unknown_corridor",
             "police_station": "unknown_police_station"}
    sel = [F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c) for c in df.columns]
    h = hour_of(ts)
    return df.select(*sel, h.alias("hour"), hour_bin_code(h).alias("hour_bin_code"))


def rate_feature(df: DataFrame, train: DataFrame, keys: list[str], target: str, out: str, alpha: float,
                 prior: float, min_count: int = 0, digits: int | None = 4, bounded: bool = False) -> DataFrame:
    """Smoothed target rate of ``keys`` looked up into ``df`` (default = prior)."""
    t = rates.smoothed_rate_table(train, keys, target, alpha, prior, min_count, out="__r")
    res = rates.lookup(df, t, keys, {"__r": prior}, bounded=bounded)
    v = np_round("__r", digits) if digits is not None else F.col("__r")
    return res.select(*[c for c in res.columns if c != "__r"], v.alias(out))


def share_feature(df: DataFrame, train: DataFrame, keys: list[str], out: str, default: float,
                  digits: int | None, non_null_total: bool = False, bounded: bool = False) -> DataFrame:
    """Count share of ``keys``: count / all training rows (or / non-NULL rows)."""
    if non_null_total:
        cond = None
        for k in keys:
            c = F.col(k).isNotNull()
            cond = c if cond is None else cond & c
        total = train.filter(cond)
    else:
        total = train
    t = rates.share_table(total, keys, out="__s")
    res = rates.lookup(df, t, keys, {"__s": default}, bounded=bounded)
    v = np_round("__s", digits) if digits is not None else F.col("__s")
    return res.select(*[c for c in res.columns if c != "__s"], v.alias(out))


# --- congestion family (GRP-01..06) ------------------------------------------------

def corridor_risk(df, train, target, prior):
    """GRP-01: alpha 20, fewer than 20 rows -> prior."""
    return rate_feature(df, train, ["corridor"], target, "corridor_risk_score", 20, prior, min_count=20)


def corridor_density(df, train):
    """GRP-02: corridor count / training rows, unseen 0."""
    return share_feature(df, train, ["corridor"], "corridor_event_density", 0.0, 5)


def hour_corridor_density(df, train):
    """GRP-03: (corridor, hour bin) pair count / training rows, unseen 0."""
    return share_feature(df, train, ["corridor", "hour_bin_code"], "hour_corridor_density", 0.0, None)


def hour_bin_load(df, train):
    """GRP-04: share of training rows in the hour bin, unseen .2 (bounded domain: 6 codes)."""
    return share_feature(df, train, ["hour_bin_code"], "hour_bin_system_load", 0.2, 5,
                         non_null_total=True, bounded=True)


def police_risk(df, train, target, prior):
    """GRP-05: alpha 10."""
    return rate_feature(df, train, ["police_station"], target, "police_station_risk", 10, prior)


def corridor_vehicle_share(df, train, cause="event_cause"):
    """GRP-06: share of vehicle breakdowns per corridor, unseen .5."""
    tr = train.select("corridor", (F.col(cause) == "vehicle_breakdown").cast("int").alias("__veh"))
    t = rates.group_counts(tr, ["corridor"], "__veh").select("corridor", F.col("mean").alias("__v"))
    res = rates.lookup(df, t, ["corridor"], {"__v": 0.5})
    return res.select(*[c for c in res.columns if c != "__v"], np_round("__v", 4).alias("vehicles_per_corridor"))


# --- zone / junction family (GRP-07..12) --------------------------------------------

def zone_features(df, train, target, prior):
    """GRP-07: zone risk (alpha 10), high-risk flag >= .10, zone density (share of non-NULL)."""
    out = rate_feature(df, train, ["zone"], target, "zone_risk_score", 10, prior)
    out = share_feature(out, train, ["zone"], "zone_event_density", 0.0, 5, non_null_total=True)
    return out.withColumn("is_high_risk_zone", flag(F.col("zone_risk_score") >= HIGH_RISK_ZONE))


def gba_risk(df, train, target, prior):
    """GRP-08."""
    return rate_feature(df, train, ["gba_identifier"], target, "gba_risk_score", 10, prior)


def junction_table(train: DataFrame, target: str, prior: float, min_count: int = 10) -> DataFrame:
    """GRP-09/10 statistics: smoothed closure rate (min 10), count, hotspot rank.

    The rank is an exact global position (range-partitioned order), so no task holds
    all junctions.
    """
    st = rates.group_counts(train, ["junction"], target)
    sm = (F.col("n") * F.col("mean") + F.lit(10 * prior)) / (F.col("n") + F.lit(10.0))
    st = global_positions(st.withColumn("__neg", -F.col("n")), ["__neg", "junction"], out="__pos")
    rank = (F.col("__pos") + 1).cast("int")
    return st.select("junction", F.when(F.col("n") < min_count, F.lit(prior)).otherwise(sm).alias("j_rate"),
                     F.col("n").alias("j_count"), rank.alias("j_rank"))


def junction_features(df, train, target, prior):
    """GRP-09 + GRP-10: rate, event count, hotspot rank (unseen 999), safety index."""
    t = junction_table(train, target, prior)
    res = rates.lookup(df, t, ["junction"], {"j_rate": prior, "j_count": 0, "j_rank": 999})
    rate = np_round("j_rate", 4)
    return res.select(*[c for c in res.columns if c not in ("j_rate", "j_count", "j_rank")],
                      rate.alias("junction_closure_rate"), F.col("j_count").cast("int").alias("junction_event_count"),
                      F.col("j_rank").cast("int").alias("junction_hotspot_rank"),
                      np_round(F.lit(1.0) - rate, 4).alias("junction_safety_index"))


def hour_rate(df, train, target, prior, rounded: bool = False):
    """GRP-11: unsmoothed closure rate per hour (bounded: 25 keys), unseen prior."""
    t = rates.group_counts(train, ["hour"], target).select("hour", F.col("mean").alias("__h"))
    res = rates.lookup(df, t, ["hour"], {"__h": prior}, bounded=True)
    v = np_round("__h", 4) if rounded else F.col("__h")
    return res.select(*[c for c in res.columns if c != "__h"], v.alias("hour_closure_rate_raw"))


def priority_rates(df, train, prior_zone: float, prior_junction: float, priority="priority"):
    """GRP-12: High-priority rate per zone and per junction (alpha 10)."""
    tr = train.withColumn("__hi", (F.col(priority) == "High").cast("int"))
    out = rate_feature(df, tr, ["zone"], "__hi", "zone_priority_rate", 10, prior_zone)
    return rate_feature(out, tr, ["junction"], "__hi", "junction_priority_rate", 10, prior_junction)


PAIR_RATES = [
    (["corridor", "zone"], "corridor_zone_risk"),
    (["hour_bin_code", "event_cause"], "hour_cause_closure_rate"),
    (["zone", "event_cause"], "zone_cause_closure_rate"),
    (["police_station", "hour_bin_code"], "police_hour_closure_rate"),
]


def pair_rates(df, train, target, prior, min_count: int = 5):
    """GRP-13: four two-key smoothed rates, alpha 10, fewer than 5 rows -> prior (unrounded).

    All four families come from one statistics pass (``statsbank``)."""
    from roadlens.operators import statsbank
    bank = statsbank.fit_bank(train, {name: keys for keys, name in PAIR_RATES}, {"y": F.col(target).cast("double")})
    out = df
    for _, name in PAIR_RATES:
        out = statsbank.apply(out, bank[name], {f"__{name}": statsbank.smoothed(10, prior, min_count)})
    return out.select(*df.columns, *[F.coalesce(F.col(f"__{name}"), F.lit(prior)).alias(name) for _, name in PAIR_RATES])


# --- interactions (INT-01, INT-02) --------------------------------------------------

def composite_risk(severity="cause_severity_score", zone="zone_risk_score", corridor="corridor_risk_score",
                   hour="hour_closure_rate_raw"):
    """INT-02: .40 severity + .25 zone + .20 corridor + .15 hour, 4 dp."""
    return np_round(F.lit(0.40) * col(severity) + F.lit(0.25) * col(zone) + F.lit(0.20) * col(corridor)
                    + F.lit(0.15) * col(hour), 4)


def interactions(df: DataFrame, prior: float) -> DataFrame:
    """INT-01: the twelve products/ANDs; absent inputs take the reference defaults."""
    have = set(df.columns)

    def c(name, default):
        return F.col(name) if name in have else F.lit(default)

    sev, zr, cr = c("cause_severity_score", prior), c("zone_risk_score", prior), c("corridor_risk_score", prior)
    hr, load = c("hour_closure_risk", prior), c("hour_bin_system_load", 0.2)
    dcc, jcr = c("dist_to_city_centre", 10.0), c("junction_closure_rate", prior)
    night, wknd, art = c("is_night_peak", 0), c("is_weekend", 0), c("is_arterial_corridor", 0)
    ban, heavy = c("is_daytime_ban_window", 0), c("is_heavy_vehicle", 0)
    obst, social = c("is_obstruction", 0), c("is_social_event", 0)
    return df.select(
        "*",
        np_round(sev * night, 4).alias("cause_x_peak"),
        np_round(sev * wknd, 4).alias("cause_x_weekend"),
        np_round(sev * art, 4).alias("cause_x_arterial"),
        np_round(sev * zr, 4).alias("cause_x_zone_risk"),
        (heavy * night).cast("int").alias("heavy_x_night"),
        (heavy * art).cast("int").alias("heavy_x_arterial"),
        (obst * ban).cast("int").alias("obstruction_x_daytime"),
        (social * wknd).cast("int").alias("social_x_weekend"),
        np_round(zr * hr, 4).alias("zone_risk_x_hour"),
        np_round(dcc * sev, 4).alias("dist_centre_x_severity"),
        np_round(cr * load, 6).alias("corridor_x_peak_load"),
        np_round(jcr * sev, 4).alias("junction_x_severity"),
    )


