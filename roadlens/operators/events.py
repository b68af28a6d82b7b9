"""Event-level domain features (EVT-01..08): literal lookups, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.constants import (
    ARTERIAL_CORRIDORS, CAUSE_CATEGORY, CAUSE_PRIORITY, CAUSE_SEVERITY, CBD_CORRIDORS,
    DEFAULT_PRIORITY, DEFAULT_SEVERITY, HEAVY_VEHICLES, HIGH_CLOSURE_THRESHOLD, NON_CORRIDOR,
    ORBITAL_CORRIDORS, PEAK_CONGESTION_CAUSES, PUBLIC_TRANSPORT, RADIAL_CORRIDORS, VEHICLE_RISK,
)
from roadlens.functions.common import col, flag, map_lookup, np_round

CATEGORIES = ["infrastructure", "obstruction", "vehicle", "social", "environmental"]
CATEGORY_FLAGS = ["is_infrastructure", "is_obstruction", "is_vehicle_incident", "is_social_event",
                  "is_environmental"]


def cause_scores(cause="event_cause") -> list[Column]:
    """EVT-01: severity and priority scores (case-sensitive keys, defaults .083/.598)."""
    return [np_round(map_lookup(cause, CAUSE_SEVERITY, DEFAULT_SEVERITY), 4).alias("cause_severity_score"),
            np_round(map_lookup(cause, CAUSE_PRIORITY, DEFAULT_PRIORITY), 4).alias("cause_priority_score")]


def cause_category(cause="event_cause") -> Column:
    """EVT-02: coarse taxonomy, unknown -> other."""
    return map_lookup(cause, CAUSE_CATEGORY, "other")


def category_flags(category="cause_category") -> list[Column]:
    return [(col(category) == F.lit(c)).cast("int").alias(n) for c, n in zip(CATEGORIES, CATEGORY_FLAGS)]


def high_closure_flag(severity="cause_severity_score") -> Column:
    """EVT-03."""
    return flag(col(severity) >= HIGH_CLOSURE_THRESHOLD)


def planned_flag(event_type="event_type") -> Column:
    return flag(col(event_type) == "planned")


def vehicle_features(veh="veh_type") -> list[Column]:
    """EVT-04: vehicle risk (unknown -> .044), heavy and public-transport flags."""
    return [np_round(map_lookup(veh, VEHICLE_RISK, VEHICLE_RISK["unknown_vehicle"]), 4).alias("veh_type_risk_score"),
            flag(col(veh).isin(HEAVY_VEHICLES)).alias("is_heavy_vehicle"),
            flag(col(veh).isin(PUBLIC_TRANSPORT)).alias("is_public_transport")]


def corridor_flags(corridor="corridor") -> list[Column]:
    """EVT-05: arterial, non-corridor, CBD."""
    c = col(corridor)
    return [flag(c.isin(ARTERIAL_CORRIDORS)).alias("is_arterial_corridor"),
            flag(c == NON_CORRIDOR).alias("is_non_corridor"),
            flag(c.isin(CBD_CORRIDORS)).alias("is_cbd_corridor")]


def route_features(corridor="corridor") -> list[Column]:
    """EVT-06: radial/orbital flags, 5-way cluster, length proxy."""
    c = col(corridor)
    radial, orbital = c.isin(RADIAL_CORRIDORS), c.isin(ORBITAL_CORRIDORS)
    cbd, nonc = c.isin(CBD_CORRIDORS), c == NON_CORRIDOR
    cluster = (F.when(radial, 0).when(orbital, 1).when(cbd, 2).when(nonc, 3).otherwise(4))
    length = (F.when(orbital, 2).when(radial, 1).when(cbd | nonc, 0).otherwise(1))
    return [flag(radial).alias("is_radial_route"), flag(orbital).alias("is_orbital_route"),
            F.coalesce(cluster, F.lit(4)).alias("corridor_cluster"),
            F.coalesce(length, F.lit(1)).alias("corridor_length_proxy")]


def peak_congestion(night="is_night_peak", morning="is_morning_peak", cause="event_cause") -> Column:
    """EVT-07: (night or morning peak) and a vehicle/infrastructure cause."""
    return ((col(night).cast("int").bitwiseOR(col(morning).cast("int")))
            .bitwiseAND(flag(col(cause).isin(PEAK_CONGESTION_CAUSES)))).alias("is_peak_congestion")


def place_flags(zone="zone", junction="junction") -> list[Column]:
    """EVT-08: unknown zone, known junction."""
    return [flag(col(zone) == "unknown_zone").alias("is_unknown_zone"),
            flag(~F.coalesce(col(junction), F.lit("nan")).isin("unknown_junction", "nan")).alias("is_known_junction")]


def event_features(df: DataFrame, cause="event_cause", veh="veh_type", event_type="event_type") -> DataFrame:
    """EVT-01..04 in one projection (the event feature engineer)."""
    base = df.select("*", *cause_scores(cause), cause_category(cause).alias("cause_category"))
    return base.select("*", *category_flags("cause_category"),
                       high_closure_flag("cause_severity_score").alias("is_high_closure_risk"),
                       planned_flag(event_type).alias("is_planned_event"),
                       *vehicle_features(F.coalesce(col(veh), F.lit("nan"))))
