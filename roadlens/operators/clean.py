"""Cleaning, projections and validation (CLN-01..05, PRJ-01..05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.constants import BOUNDS, REQUEST_BOUNDS
from roadlens.functions.common import col
from roadlens.functions.temporal import parse_ts


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """CLN-01: drop the configured columns that exist (absent names are ignored)."""
    return df.drop(*[c for c in columns if c in df.columns])


def dedupe(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """CLN-02: exact-duplicate removal.  A hash aggregate on all (or ``subset``)
    columns; duplicates are identical so "keep first" needs no ordering."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """CLN-02 report: rows before, after, removed (one aggregate row)."""
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    after = df.dropDuplicates().agg(F.count(F.lit(1)).alias("rows_after"))
    return before.crossJoin(after).select("rows_before", "rows_after",
                                          (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))


def coord_flag(lat="latitude", lon="longitude", bounds=BOUNDS) -> Column:
    """CLN-03: 1 when outside the box or NULL."""
    (la0, la1), (lo0, lo1) = bounds["latitude"], bounds["longitude"]
    inside = col(lat).between(la0, la1) & col(lon).between(lo0, lo1)
    return F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)


def ts_parse_flag(c="start_datetime") -> Column:
    """CLN-04: 1 when the timestamp text does not parse."""
    return parse_ts(c).isNull().cast("int")


def clean(df: DataFrame, drop: list[str] = (), dedup: bool = True, lat="latitude", lon="longitude",
          ts_col="start_datetime", bounds=BOUNDS) -> DataFrame:
    """CLN-05: drop -> dedupe -> coordinate flag -> timestamp flag (fixed order)."""
    out = drop_columns(df, list(drop))
    if dedup:
        out = dedupe(out)
    extra = []
    if lat in out.columns and lon in out.columns:
        extra.append(coord_flag(lat, lon, bounds).alias("coord_out_of_bounds"))
    if ts_col in out.columns:
        extra.append(ts_parse_flag(ts_col).alias("datetime_parse_failed"))
    return out.select("*", *extra)


def extract_targets(df: DataFrame, closure="requires_road_closure", priority="priority",
                    targets=("requires_road_closure", "priority", "event_cause")) -> DataFrame:
    """PRJ-01: bool -> int closure label, High/Low -> 1/0, targets removed from features."""
    feats = [c for c in df.columns if c not in targets]
    return df.select(*feats,
                     col(closure).cast("int").alias("y_closure"),
                     F.when(col(priority) == "High", 1).otherwise(0).alias("y_priority"))


def pad_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ-02: add every field of ``schema`` that ``df`` lacks as a typed NULL."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
                            if f.name not in have])


def align_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """PRJ-03: ordered feature list; absent and NULL -> 0."""
    have = set(df.columns)
    return df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in have
                              else F.lit(0.0).alias(f) for f in features])


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
           T.BooleanType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def model_matrix(df: DataFrame, keep: list[str] = (), subset: list[str] | None = None) -> DataFrame:
    """PRJ-04: numeric columns only (strings dropped), NULL -> 0, optional subset."""
    feats = subset if subset is not None else numeric_columns(df, exclude=keep)
    return align_features(df, feats, keep)


def validate_rows(df: DataFrame, ts_col="start_datetime", lat="latitude", lon="longitude",
                  bounds=REQUEST_BOUNDS) -> DataFrame:
    """PRJ-05: array of validation messages per row; empty array = valid."""
    (la0, la1), (lo0, lo1) = bounds["latitude"], bounds["longitude"]
    msgs = F.array_compact(F.array(
        F.when(col(ts_col).isNull(), F.lit("start_datetime is required"))
        .when(parse_ts(ts_col).isNull(), F.lit("start_datetime is not a valid timestamp")),
        F.when(col(lat).isNull(), F.lit("latitude is required"))
        .when(~col(lat).between(la0, la1), F.lit("latitude outside service area")),
        F.when(col(lon).isNull(), F.lit("longitude is required"))
        .when(~col(lon).between(lo0, lo1), F.lit("longitude outside service area")),
    ))
    return df.select("*", msgs.alias("errors"), (F.size(msgs) == 0).alias("is_valid"))
