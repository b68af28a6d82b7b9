"""Readers for the driver tables and the ``incidents`` binding over ``events``.

The reference's incident CSV is not shipped, so incident-shaped rows are derived
from ``events`` with integer arithmetic only (FIXTURES/SURVEY 7.2).  The binding
is a pure projection: Catalyst prunes it to the columns a query touches and the
parquet scan reads only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.constants import ARTERIAL_CORRIDORS, CAUSE_SEVERITY, VEHICLE_RISK

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Binding vocabularies (our own choice; both engines use these same lists).
BIND_CAUSES = list(CAUSE_SEVERITY)                                   # 17
BIND_VEHICLES = [v for v in VEHICLE_RISK if v != "unknown_vehicle"]  # 10
BIND_CORRIDORS = ARTERIAL_CORRIDORS + [
    "CBD 1", "CBD 2", "Non-corridor", "Bannerghata Road", "Sarjapur Road",
    "IRR(Thanisandra road)", "West of Chord Road",
]                                                                    # 18
BIND_ZONES = ["East", "West", "North", "South", "Central", "Mahadevapura", "Bommanahalli",
              "Yelahanka", "RR Nagar", "Dasarahalli"]                # 10
BIND_GBA = ["GBA-North", "GBA-South", "GBA-East", "GBA-West", "GBA-Central"]  # 5
BIND_DESCRIPTIONS = [
    "Tree fall blocking road near metro station",
    "Vehicle breakdown, slow moving traffic",
    "Water logging after heavy rain, road closed",
    "Accident between bus and truck",
    "Pothole on the left lane",
    "  Heavy   congestion  near   junction  ",
    "Signal light not working at the divider",
    "",
]
BIND_STREETS = ["Outer Ring Road", "Bellary Road", "Hosur Road NH 44", "MG Road"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(idx: Column, values: list) -> Column:
    """Element of a literal vocabulary by 0-based index (a CASE, codegen friendly)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident fact table bound to ``events`` (one row per event)."""
    return incidents_from(read_table(spark, sf_dir, "events"))


def incidents_from(ev: DataFrame) -> DataFrame:
    """The incident projection over any ``events``-shaped frame (batch or streaming)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    ts = F.when(eid % 71 == 0, F.lit(None)).otherwise(F.col("ts").cast("timestamp"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start_str = F.when(eid % 71 == 0, F.lit("not a timestamp")).otherwise(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    created = F.when(eid % 71 == 0, F.lit(None)).otherwise(
        F.timestamp_micros(micros + ((eid % 240) - 30) * F.lit(60000000)))
    desc_idx = (eid * 13 + uid) % len(BIND_DESCRIPTIONS)
    pin = F.when(eid % 3 == 0, F.concat(F.lit(", Bengaluru Pin-5600"),
                                        F.lpad((eid % 100).cast("string"), 2, "0"))).otherwise(F.lit(""))
    address = F.when(eid % 97 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("No "), (eid % 300).cast("string"), F.lit(", "), pick(uid % 4, BIND_STREETS), pin))
    etype = F.col("event_type")
    status = (F.when(etype == "signup", "PENDING").when(etype == "click", "DISPATCHED")
              .when(etype == "error", "ON_SCENE").otherwise("RESOLVED"))
    return ev.select(
        eid.alias("id"),
        ts.alias("ts"),
        start_str.alias("start_datetime"),
        created.alias("created_ts"),
        (F.lit(12.80) + ((eid * 7919) % 4700).cast("double") / F.lit(10000.0)).alias("latitude"),
        (F.lit(77.31) + ((eid * 6101) % 4600).cast("double") / F.lit(10000.0)).alias("longitude"),
        pick((eid * 31 + uid) % 17, BIND_CAUSES).alias("event_cause"),
        F.when(eid % 17 == 0, "planned").otherwise("unplanned").alias("event_type"),
        F.when(eid % 3 == 0, "no").otherwise("yes").alias("authenticated"),
        F.when(eid % 5 < 2, F.lit(None)).otherwise(pick(uid % 10, BIND_VEHICLES)).alias("veh_type"),
        F.when(eid % 41 == 0, F.lit(None)).otherwise(pick(uid % 18, BIND_CORRIDORS)).alias("corridor"),
        F.concat(F.lit("PS"), (uid % 54).cast("string")).alias("police_station"),
        F.when(eid % 7 < 4, F.lit(None)).otherwise(pick(uid % 10, BIND_ZONES)).alias("zone"),
        F.when(eid % 7 < 4, F.lit(None)).otherwise(pick(uid % 5, BIND_GBA)).alias("gba_identifier"),
        F.when(eid % 10 < 7, F.lit(None)).otherwise(
            F.concat(F.lit("J"), ((uid * 7 + eid) % 294).cast("string"))).alias("junction"),
        F.when(eid % 6 == 5, F.lit(None)).otherwise(pick(desc_idx, BIND_DESCRIPTIONS)).alias("description"),
        address.alias("address"),
        F.when(((etype == "error") & (F.col("value") > 90)) | (F.col("value") > 150), 1)
        .otherwise(0).alias("requires_road_closure"),
        F.when(eid % 13 < 8, "High").otherwise("Low").alias("priority"),
        F.col("value").alias("duration_mins"),
        (F.lit(1) + eid % 4).cast("int").alias("num_lanes"),
        status.alias("status"),
        (eid % 5 != 0).alias("is_train"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring/evaluation rows: ``labels`` with a deterministic score from document length.

    score = n_chars / (n_chars + 2000) in (0, 1); label = quality.
    """
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (lab.join(docs, "doc_id", "inner")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                    (F.col("n_chars").cast("double") / (F.col("n_chars") + F.lit(2000.0))).alias("score")))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera readings bound to ``events`` (6 cameras by user): status, density, queue,
    vehicle count, uptime, incident."""
    return cameras_from(read_table(spark, sf_dir, "events"))


def cameras_from(ev: DataFrame) -> DataFrame:
    """The camera projection over any ``events``-shaped frame (batch or streaming)."""
    v = F.col("value")
    return ev.select(
        ((F.col("user_id") % 6) + 1).alias("camera_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when((F.col("event_type") == "error") & (v > 200), "OFFLINE").otherwise("ONLINE").alias("status"),
        F.when(v > 300, "JAMMED").when(v > 150, "HEAVY").when(v > 60, "MODERATE").otherwise("LOW").alias("density"),
        (v * F.lit(2.0)).alias("queue_length_m"), F.floor(v * 3).cast("int").alias("vehicle_count"),
        (F.lit(100.0) - (F.col("event_id") % 50).cast("double") / F.lit(10.0)).alias("uptime_pct"),
        F.when(v > 250, "Congestion").otherwise("None").alias("incident"))


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rainfall bound to ``view`` events (value over 100 -> value / 20 mm), visibility
    (10 km, less half a kilometre for each mm) and flood risk (MEDIUM over 5 mm, HIGH over 10)
    from it, and a weather code cycling through the code table by hour."""
    from roadlens.constants import WEATHER_CODES
    ev = read_table(spark, sf_dir, "events").filter((F.col("event_type") == "view") & F.col("ts").isNotNull())
    hr = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    w = ev.groupBy(hr.alias("hr")).agg(F.avg(F.when(F.col("value") > 100, F.col("value") / F.lit(20.0))
                                             .otherwise(F.lit(0.0))).alias("rain_mm"))
    codes = list(WEATHER_CODES) + [9999]
    rain = F.col("rain_mm")
    return w.select("hr", "rain_mm", (F.lit(10.0) - F.least(rain, F.lit(16.0)) / 2).alias("visibility_km"),
                    F.when(rain > 10, "HIGH").when(rain > 5, "MEDIUM").otherwise("LOW").alias("flood_risk"), pick((F.unix_seconds("hr") / 3600).cast("long") % 13, codes).alias("code"))
