"""Dashboard filters, aggregates, sorts and limits (FLT, AGG, SRT, GEO-10/11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.constants import ACTIVE_FAMILIES, SEVERITY_WEIGHT
from roadlens.functions.common import col, contains_any, map_lookup
from roadlens.functions.geo import haversine_km

ACTIVE_STATUSES = ["PENDING", "DISPATCHED", "ON_SCENE"]
ZOOM_THRESHOLDS = {11: 0.04, 12: 0.02, 13: 0.01, 14: 0.005}


# ------------------------------------------------------------------------- filters

def search_filter(df: DataFrame, query: str, search_cols: list[str], category: tuple | None = None,
                  equals: dict | None = None) -> DataFrame:
    """FLT-01: case-insensitive substring over several columns AND category contains
    AND equality filters; the value ``All`` disables a filter.  Pushed below scans."""
    q = query.lower()
    cond = None
    for c in search_cols:
        t = F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q))
        cond = t if cond is None else cond | t
    if category and category[1] != "All":
        cond = cond & F.contains(F.lower(F.col(category[0])), F.lit(category[1].lower()))
    for c, v in (equals or {}).items():
        if v != "All":
            cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond)


def equals_ci(df: DataFrame, filters: dict) -> DataFrame:
    """FLT-02: case-insensitive equality on each column (``All`` disables)."""
    cond = F.lit(True)
    for c, v in filters.items():
        if v != "All":
            cond = cond & (F.lower(F.col(c)) == F.lower(F.lit(v)))
    return df.filter(cond)


def active_families(df: DataFrame, cause="event_cause", desc="description", status="status") -> DataFrame:
    """FLT-04: active reports tagged by keyword family (water, accident, construction)."""
    lc = F.lower(F.coalesce(col(cause), F.lit("")))
    ld = F.lower(F.coalesce(col(desc), F.lit("")))
    fams = {name: (contains_any(lc, cw) | contains_any(ld, dw)) for name, (cw, dw) in ACTIVE_FAMILIES.items()}
    any_fam = fams["water"] | fams["accident"] | fams["construction"]
    return (df.filter(col(status).isin(ACTIVE_STATUSES) & any_fam)
            .select("id", status, fams["water"].alias("is_water"), fams["accident"].alias("is_accident"),
                    fams["construction"].alias("is_construction")))


# ------------------------------------------------------------------------- map layers

def grid_clusters(df: DataFrame, zoom: int = 12, lat="latitude", lon="longitude", weight="risk_weight") -> DataFrame:
    """GEO-10 (re-aimed): order-free clustering on a grid sized by zoom.

    The reference's greedy running-centroid pass depends on row order and cannot be
    split across tasks; grid cells of the same threshold are its parallel form.
    """
    t = ZOOM_THRESHOLDS.get(zoom, 0.04 if zoom <= 11 else 0.005)
    return (df.groupBy(F.floor(col(lat) / F.lit(t)).cast("long").alias("cell_lat"),
                       F.floor(col(lon) / F.lit(t)).cast("long").alias("cell_lon"))
            .agg(F.round(F.avg(lat), 6).alias("center_lat"), F.round(F.avg(lon), 6).alias("center_lon"),
                 F.count(F.lit(1)).alias("n_incidents"), F.max(weight).alias("max_risk_weight")))


def heat_surface(df: DataFrame, lat="latitude", lon="longitude", cell: float = 0.01) -> DataFrame:
    """GEO-11 (re-aimed): each incident weighs into the centres of its 3x3 neighbouring
    cells with the ring opacities .22 (<= 120 m), .07 (<= 400 m), .03 (<= 800 m).

    A 0.01 deg cell is > 1.08 km wide, so every centre within 800 m is among the 9
    neighbours: the explode is exact, fixed fan-out (x9), and the sum is a plain
    partial aggregate per cell (hot cells are combined map-side)."""
    offs = F.array(F.lit(-1), F.lit(0), F.lit(1))
    base = df.select(col(lat).alias("la"), col(lon).alias("lo"),
                     F.floor(col(lat) / F.lit(cell)).cast("long").alias("bl"),
                     F.floor(col(lon) / F.lit(cell)).cast("long").alias("bn"))
    ex = (base.select("la", "lo", "bl", "bn", F.explode(offs).alias("dl"))
          .select("la", "lo", "bn", (F.col("bl") + F.col("dl")).alias("cell_lat"), F.explode(offs).alias("dn"))
          .select("la", "lo", "cell_lat", (F.col("bn") + F.col("dn")).alias("cell_lon")))
    dk = haversine_km("la", "lo", (F.col("cell_lat") + F.lit(0.5)) * F.lit(cell),
                      (F.col("cell_lon") + F.lit(0.5)) * F.lit(cell))
    w = (F.when(dk <= 0.12, 0.22).otherwise(0.0) + F.when(dk <= 0.4, 0.07).otherwise(0.0)
         + F.when(dk <= 0.8, 0.03).otherwise(0.0))
    return (ex.select("cell_lat", "cell_lon", w.alias("w")).filter(F.col("w") > 0)
            .groupBy("cell_lat", "cell_lon").agg(F.round(F.sum("w"), 6).alias("heat"),
                                                 F.count(F.lit(1)).alias("n_contrib")))


def severity_weight(level) -> F.Column:
    return map_lookup(level, SEVERITY_WEIGHT, 0)



# ------------------------------------------------------------------------- aggregates (AGG)

def zone_congestion(df: DataFrame, zone="zone", score="score", status="status") -> DataFrame:
    """AGG-01: per zone active count and mean congestion score (one partial aggregate)."""
    return df.groupBy(zone).agg(F.count_if(F.col(status) != "RESOLVED").alias("active_events"),
                                F.avg(score).alias("avg_score"))


def network_summary(zones: DataFrame) -> DataFrame:
    """AGG-02: mean of zone means, total active, level (HIGH when >= 50)."""
    m = F.avg("avg_score")
    return zones.agg(F.round(m, 6).alias("network_congestion_score"),
                     F.sum("active_events").alias("active_incidents"),
                     F.when(m >= 50, "HIGH").otherwise("MEDIUM").alias("network_risk_level"))


def _tier75(c):
    from roadlens.functions.common import first_match
    return first_match([(c >= 75, "CRITICAL"), (c >= 55, "HIGH"), (c >= 35, "MEDIUM")], "LOW")


def junction_table(df: DataFrame, junction="nearest_junction", score="score") -> DataFrame:
    """AGG-03: per junction mean score, tier 75/55/35, incidents, delay = .45 * score."""
    g = df.groupBy(junction).agg(F.avg(score).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col(junction).alias("name"), F.round("s", 6).alias("congestion_score"),
                    _tier75(F.col("s")).alias("risk_level"), F.col("n").alias("incident_count"),
                    F.round(F.col("s") * F.lit(0.45), 6).alias("avg_delay_mins"))


def two_hour_bins(df: DataFrame, ts="ts") -> DataFrame:
    """AGG-04: incidents per 2-hour bin, empty bins kept, share scaled x6.5 clipped to [10, 98]."""
    spark = df.sparkSession
    valid = df.filter(F.col(ts).isNotNull())
    counts = valid.groupBy((F.floor(F.hour(ts) / 2) * 2).cast("long").alias("hour_bin")).agg(F.count(F.lit(1)).alias("n"))
    total = valid.agg(F.count(F.lit(1)).alias("tot"))
    bins = spark.range(0, 24, 2).select(F.col("id").alias("hour_bin"))
    j = bins.join(F.broadcast(counts), "hour_bin", "left").crossJoin(F.broadcast(total))
    n = F.coalesce(F.col("n"), F.lit(0))
    pct = F.greatest(F.lit(10.0), F.least(F.bround(n / F.col("tot") * 100 * 6.5, 0), F.lit(98.0))).cast("long")
    return j.select("hour_bin", n.alias("incidents"), pct.alias("congestion_pct"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """AGG-05: count and share (2 dp, half-even) per key; total by a window over the aggregate."""
    from roadlens.functions.common import np_round
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return g.select(key, "count", np_round(F.col("count") / F.sum("count").over(Window.partitionBy()) * 100, 2)
                    .alias("percentage"))


def kpi_counts(df: DataFrame, ts="ts") -> DataFrame:
    """AGG-06: one conditional aggregate for all KPI tiles."""
    last = df.agg(F.max(F.to_date(ts)).alias("__ld"))
    j = df.crossJoin(F.broadcast(last))
    s, r = F.col("status"), F.col("risk_level")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(s != "RESOLVED").alias("open"),
                 F.count_if(s == "RESOLVED").alias("resolved"), F.count_if(r.isin("HIGH", "CRITICAL")).alias("high"),
                 F.count_if((r == "CRITICAL") & (s != "RESOLVED")).alias("critical_active"),
                 F.count_if(s == "PENDING").alias("pending"), F.count_if(s == "DISPATCHED").alias("dispatched"),
                 F.count_if(s == "ON_SCENE").alias("on_scene"),
                 F.count_if(F.to_date(ts) == F.col("__ld")).alias("today"))


def top_k_per_group(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """AGG-07: counts per (group, item) then row_number within group on the aggregate."""
    g = df.filter(F.col(item).isNotNull()).groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(item))
    return g.select(group, item, "n", F.row_number().over(w).alias("rk")).filter(F.col("rk") <= k)


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """AGG-08: top n keys by volume (TakeOrderedAndProject over the aggregate)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key)).limit(n)


def latest_per_camera(cam: DataFrame) -> DataFrame:
    """Latest reading per camera: max over a (ts, event_id) struct, a partial aggregate."""
    fields = ["status", "density", "queue_length_m", "vehicle_count", "uptime_pct", "incident"]
    g = cam.groupBy("camera_id").agg(F.max(F.struct("ts", "event_id", *fields)).alias("s"))
    return g.select("camera_id", *[F.col(f"s.{f}").alias(f) for f in fields])


def camera_fleet(snap: DataFrame) -> DataFrame:
    """AGG-09: online averages, total vehicles, worst camera (max queue, ties -> lowest id), incidents."""
    on = F.col("status") == "ONLINE"
    return snap.agg(F.round(F.avg(F.when(on, F.col("uptime_pct"))), 6).alias("avg_uptime"),
                    F.round(F.avg(F.when(on, F.col("queue_length_m"))), 6).alias("avg_queue"),
                    F.sum("vehicle_count").alias("total_vehicles"),
                    F.max(F.struct("queue_length_m", (-F.col("camera_id")).alias("neg_id")))["neg_id"].alias("w"),
                    F.count_if(F.col("incident") != "None").alias("incident_cameras")) \
        .select("avg_uptime", "avg_queue", "total_vehicles", (-F.col("w")).alias("worst_camera"), "incident_cameras")


def cause_crosstab(df: DataFrame) -> DataFrame:
    """AGG-10: per cause closure rate and High-priority rate (source of the score maps)."""
    return df.groupBy("event_cause").agg(F.count(F.lit(1)).alias("n"),
                                         F.avg(F.col("requires_road_closure").cast("double")).alias("closure_rate"),
                                         F.avg((F.col("priority") == "High").cast("double")).alias("high_priority_rate"))


def before_after(df: DataFrame, split: str) -> DataFrame:
    """AGG-11: KPI values before/after a split time and their relative change (%)."""
    cut = F.to_timestamp(F.lit(split))
    b, a = F.col("ts") < cut, F.col("ts") >= cut
    row = df.agg(F.count_if(b).cast("double").alias("n_b"), F.count_if(a).cast("double").alias("n_a"),
                 F.avg(F.when(b, F.col("score"))).alias("s_b"), F.avg(F.when(a, F.col("score"))).alias("s_a"),
                 F.avg(F.when(b, F.col("duration_mins"))).alias("d_b"), F.avg(F.when(a, F.col("duration_mins"))).alias("d_a"),
                 F.avg(F.when(b, F.col("requires_road_closure").cast("double"))).alias("c_b"),
                 F.avg(F.when(a, F.col("requires_road_closure").cast("double"))).alias("c_a"))
    metrics = [("incidents", "n"), ("avg_congestion_score", "s"), ("avg_duration_mins", "d"), ("closure_rate", "c")]
    long = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{p}_b").alias("before"),
                                                   F.col(f"{p}_a").alias("after")) for m, p in metrics])).alias("r")).select("r.*")
    return long.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"),
                       F.round((F.col("after") - F.col("before")) / F.col("before") * 100, 6).alias("pct_change"))


def weekly_trend(df: DataFrame) -> DataFrame:
    """AGG-12: totals per ISO week (Monday start)."""
    return (df.filter(F.col("ts").isNotNull())
            .groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))
            .agg(F.count(F.lit(1)).alias("incidents"), F.round(F.avg("score"), 6).alias("avg_score"),
                 F.count_if(F.col("requires_road_closure") == 1).alias("closures")))


def live_vs_baseline(df: DataFrame) -> DataFrame:
    """AGG-13: live (latest day) vs baseline (other days) score and delay per hour."""
    d = df.filter(F.col("ts").isNotNull())
    last = d.agg(F.max(F.to_date("ts")).alias("__ld"))
    j = d.crossJoin(F.broadcast(last))
    live = F.to_date("ts") == F.col("__ld")
    return j.groupBy(F.hour("ts").alias("hour")).agg(
        F.round(F.avg(F.when(live, F.col("score"))), 6).alias("live_score"),
        F.round(F.avg(F.when(~live, F.col("score"))), 6).alias("baseline_score"),
        F.round(F.avg(F.when(live, F.col("score") * F.lit(0.45))), 6).alias("live_delay"),
        F.round(F.avg(F.when(~live, F.col("score") * F.lit(0.45))), 6).alias("baseline_delay"))


def weekday_profile(df: DataFrame) -> DataFrame:
    """AGG-14: typical weekday volume (per distinct week) vs the last 7 days, alert count."""
    d = df.filter(F.col("ts").isNotNull())
    meta = d.agg(F.max("ts").alias("__mx"), F.countDistinct(F.date_trunc("week", "ts")).alias("__nw"))
    j = d.crossJoin(F.broadcast(meta))
    recent = F.col("ts") > F.col("__mx") - F.expr("INTERVAL 7 DAYS")
    return j.groupBy(F.weekday("ts").alias("day_of_week")).agg(
        F.round(F.count(F.lit(1)) / F.first("__nw"), 6).alias("typical"),
        F.count_if(recent).alias("active"),
        F.count_if(recent & (F.col("risk_level") == "CRITICAL")).alias("alerts"))


def rain_impact(df: DataFrame, weather: DataFrame) -> DataFrame:
    """AGG-15: incidents joined to hourly rainfall; per rain bin delay and speed drop; overall corr."""
    j = df.filter(F.col("ts").isNotNull()).join(weather.select("hr", "rain_mm"),
                                                F.date_trunc("hour", F.col("ts")) == F.col("hr"), "inner")
    r = F.col("rain_mm")
    b = F.when(r == 0, "0").when(r <= 2, "0-2").when(r <= 10, "2-10").otherwise(">10")
    corr = j.agg(F.round(F.corr(r, F.col("score") * F.lit(0.45)), 6).alias("rain_delay_corr"))
    g = j.groupBy(b.alias("rain_bin")).agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.avg(F.col("score") * F.lit(0.45)), 6).alias("avg_delay"),
                                           F.round(F.avg(F.least(r * F.lit(2.0), F.lit(40.0))), 6).alias("speed_drop_pct"))
    return g.crossJoin(F.broadcast(corr))


def live_traffic_summary(df: DataFrame, weather: DataFrame) -> DataFrame:
    """SCR-15: traffic mix from the active count at a snapshot (latest day, 12:00) and weather delay."""
    from roadlens.operators.score import traffic_mix, weather_delay
    last = df.agg(F.max(F.to_date("ts")).alias("__ld"))
    n = df.crossJoin(F.broadcast(last)).agg(F.count_if((F.col("status") != "RESOLVED") & (F.to_date("ts") == F.col("__ld"))
                                                       & (F.hour("ts") == 12)).alias("n_active"))
    w = weather.agg(F.max("rain_mm").alias("__r")).select(weather_delay("__r").alias("weather_delay"))
    return n.crossJoin(w).select("n_active", *traffic_mix("n_active"), "weather_delay")


# ------------------------------------------------------------------------- sorts (SRT)

def priority_queue(df: DataFrame) -> DataFrame:
    """SRT-01: per status queue position by severity weight desc, time desc, id.

    Positions come from the distributed prefix count (P1), never a single-partition window."""
    from roadlens.operators.prefix import global_positions
    act = df.filter(F.col("status") != "RESOLVED").select(
        "id", "status", "risk_level", (-severity_weight(F.col("risk_level"))).alias("__w"),
        F.coalesce(-F.unix_micros("ts"), F.lit(2 ** 62)).alias("__t"))
    return global_positions(act, ["__w", "__t", "id"], ["status"], out="queue_pos").select(
        "id", "status", "risk_level", "queue_pos")


def top_lists(df: DataFrame) -> DataFrame:
    """SRT-02: top-5 zones by mean score, 5 most recent active, top-3 critical alerts."""
    zones = (df.groupBy("zone").agg(F.round(F.avg("score"), 6).alias("value"))
             .orderBy(F.col("value").desc(), "zone").limit(5)
             .select(F.lit("top_zones").alias("list"), F.col("zone").alias("item"), "value"))
    act = df.filter(F.col("status") != "RESOLVED")
    recent = (act.filter(F.col("ts").isNotNull()).orderBy(F.col("ts").desc(), "id").limit(5)
              .select(F.lit("recent").alias("list"), F.col("id").cast("string").alias("item"),
                      F.unix_micros("ts").cast("double").alias("value")))
    alerts = (act.filter(F.col("risk_level") == "CRITICAL").orderBy(F.col("prob").desc(), F.col("ts").desc_nulls_last(), "id")
              .limit(3).select(F.lit("alerts").alias("list"), F.col("id").cast("string").alias("item"),
                               F.round("prob", 6).alias("value")))
    return zones.unionByName(recent).unionByName(alerts)


def lifecycle_log(df: DataFrame, newest: int = 30) -> DataFrame:
    """SRT-03: 1-4 log rows per incident (reported/dispatch/scene/resolved at +0/30/180/600 s
    by status reached), newest first, top ``newest`` (fixed x4 fan-out, then TakeOrdered)."""
    from roadlens.constants import LIFECYCLE
    lvl = (F.when(F.col("status") == "PENDING", 0).when(F.col("status") == "DISPATCHED", 1)
           .when(F.col("status") == "ON_SCENE", 2).otherwise(3))
    steps = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(off).alias("off"), F.lit(i).alias("lvl"))
                      for i, (k, off) in enumerate(LIFECYCLE)])
    ex = df.filter(F.col("ts").isNotNull()).select("id", "ts", lvl.alias("reached"), F.explode(steps).alias("s"))
    logs = ex.filter(F.col("s.lvl") <= F.col("reached")).select(
        "id", F.col("s.kind").alias("kind"), (F.unix_micros("ts") + F.col("s.off") * 1000000).alias("log_us"))
    return logs.orderBy(F.col("log_us").desc(), "id", "kind").limit(newest)
