"""Joins, set operations and keyed sinks expressed as joins (JON-01..07, SET-01, SNK-04/05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.constants import RESOURCES
from roadlens.operators import rates


def lookup_with_default(df: DataFrame, dim: DataFrame, on: dict, defaults: dict) -> DataFrame:
    """JON-01: left equi lookup with defaults; the dimension is broadcast only after its
    size is checked (rates.lookup), otherwise a shuffle join."""
    return rates.lookup(df, dim, on, defaults)


def left_fill(df: DataFrame, right: DataFrame, keys: list[str], fills: dict) -> DataFrame:
    """JON-02: left merge, missing measures filled."""
    return df.join(right, keys, "left").fillna(fills)


def full_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JON-03: full outer merge on keys (coalesced key columns)."""
    return a.join(b, keys, "full_outer")


def upsert_union(cached: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """JON-04: live rows replace cached rows with the same key (anti join + union)."""
    return cached.join(live.select(*keys), keys, "left_anti").unionByName(live)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04: ``ON CONFLICT DO NOTHING`` — append only keys not present yet."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def status_updates(inc: DataFrame) -> DataFrame:
    """Update batch used by SNK-05: every 7th id resolved + ids that do not exist."""
    a = inc.filter(F.col("id") % 7 == 0).select("id", F.lit("RESOLVED").alias("new_status"))
    b = inc.filter(F.col("id") % 701 == 0).select((F.col("id") + 1000000000).alias("id"), F.lit("RESOLVED").alias("new_status"))
    return a.unionByName(b)


def merge_updates(table: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """SNK-05: keyed merge (left join + coalesce) and the list of unmatched update keys."""
    merged = (table.join(updates, key, "left")
              .select(key, F.coalesce("new_status", "status").alias("status"),
                      F.col("new_status").isNotNull().alias("updated")))
    unmatched = updates.join(table.select(key), key, "left_anti").select(key)
    return merged, unmatched


def first_match_per_place(df: DataFrame) -> DataFrame:
    """JON-06: per police station, the earliest unresolved HIGH/CRITICAL incident
    (nearest-station theta join as a literal 11-way argmin; earliest by min(struct(ts, id)))."""
    from roadlens.operators.score import nearest_station
    name, _ = nearest_station()
    cand = df.filter(F.col("risk_level").isin("HIGH", "CRITICAL") & (F.col("status") != "RESOLVED")
                     & F.col("ts").isNotNull()).select(name.alias("station"), "ts", "id")
    g = cand.groupBy("station").agg(F.min(F.struct("ts", "id")).alias("m"))
    return g.select("station", F.col("m.id").alias("first_incident"), F.col("m.ts").alias("first_ts"))


def team_availability(spark, inc: DataFrame) -> DataFrame:
    """JON-07: teams left-joined to their unresolved assignments -> EN_ROUTE / ON_SCENE / AVAILABLE."""
    teams = spark.createDataFrame([(n, t) for n, t, _ in RESOURCES], "name string, type string")
    act = (inc.filter(F.col("status").isin("DISPATCHED", "ON_SCENE"))
           .groupBy(F.col("assigned_resource").alias("name"))
           .agg(F.count(F.lit(1)).alias("n_active"), F.count_if(F.col("status") == "DISPATCHED").alias("n_d"),
                F.count_if(F.col("status") == "ON_SCENE").alias("n_s")))
    j = teams.join(act, "name", "left")
    st = F.when(F.col("n_d") > 0, "EN_ROUTE").when(F.col("n_s") > 0, "ON_SCENE").otherwise("AVAILABLE")
    return j.select("name", "type", st.alias("team_status"), F.coalesce("n_active", F.lit(0)).alias("active_assignments"))

