"""Scans (SRC-01..04): explicit schemas, never schema inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Incident CSV (kept columns + targets); timestamps stay text and are parsed once.
INCIDENT_CSV = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("start_datetime", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("event_type", T.StringType()), T.StructField("authenticated", T.StringType()),
    T.StructField("veh_type", T.StringType()), T.StructField("corridor", T.StringType()),
    T.StructField("police_station", T.StringType()), T.StructField("gba_identifier", T.StringType()),
    T.StructField("zone", T.StringType()), T.StructField("junction", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("address", T.StringType()),
    T.StructField("requires_road_closure", T.BooleanType()), T.StructField("priority", T.StringType()),
    T.StructField("event_cause", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])

CITIZEN_REPORT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("start_datetime", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("event_cause", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("original_language", T.StringType()), T.StructField("translated_description", T.StringType()),
    T.StructField("veh_type", T.StringType()), T.StructField("duration_mins", T.DoubleType()),
    T.StructField("num_lanes", T.IntegerType()), T.StructField("risk_level", T.StringType()),
    T.StructField("probability_closure", T.DoubleType()), T.StructField("congestion_score", T.IntegerType()),
    T.StructField("nearest_junction", T.StringType()), T.StructField("nearest_junction_dist_km", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("assigned_resource", T.StringType()),
    T.StructField("image", T.StringType()),
])

EVENT_INPUT = T.StructType([
    T.StructField("start_datetime", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("event_cause", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("veh_type", T.StringType()),
    T.StructField("duration_mins", T.DoubleType()), T.StructField("num_lanes", T.IntegerType()),
    T.StructField("zone_id", T.StringType()), T.StructField("road_category", T.StringType()),
])

REQUIRED_UPLOAD = ["start_datetime", "latitude", "longitude"]
UPLOAD_DEFAULTS = {"event_cause": "others", "description": "", "duration_mins": 30.0, "num_lanes": 2}


def scan_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: header CSV with an explicit schema; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(INCIDENT_CSV).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def scan_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-02: citizen-report snapshot, newest first."""
    reader = spark.read.schema(CITIZEN_REPORT)
    df = reader.json(path) if fmt == "json" else reader.parquet(path)
    return df.orderBy(F.col("start_datetime").desc_nulls_last(), F.col("id"))


def normalise_upload(df: DataFrame) -> DataFrame:
    """SRC-03: require the three columns, default the optional ones."""
    missing = [c for c in REQUIRED_UPLOAD if c not in df.columns]
    if missing:
        raise ValueError(f"upload lacks required columns: {missing}")
    out = df
    for c, v in UPLOAD_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


def scan_upload(spark: SparkSession, path: str) -> DataFrame:
    return normalise_upload(spark.read.option("header", True).schema(EVENT_INPUT).csv(path))


def scan_handoff(spark: SparkSession, features_path: str, target_path: str, key: str = "id") -> DataFrame:
    """SRC-04: feature matrix + target joined by key (not by row position)."""
    return spark.read.parquet(features_path).join(spark.read.parquet(target_path), key, "inner")
