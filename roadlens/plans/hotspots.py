"""Flagship: closure-risk hotspots per zone.

incidents -> clean flags (CLN-03/04) -> constant imputation (IMP-02) -> hour, hour
bin (DTM-02/05) -> fit on training rows: zone rate (GRP-07), corridor rate
(GRP-01), hourly rate (GRP-11) in ONE statistics pass -> cause severity (EVT-01) -> composite (INT-02)
-> per-zone KPIs (AGG-01), top 10 by mean composite risk.

Plan shape: one scan of ``events`` (pruned to the columns used) feeds three
small fit aggregates (partial aggregation map-side) and the fact projection;
statistics tables are broadcast behind a size check; the final aggregate has one
group per zone, so the top-10 is a TakeOrderedAndProject over a tiny input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.constants import CAUSE_SEVERITY, JUNCTIONS
from roadlens.functions.common import np_round
from roadlens.operators import clean, events, rates, statsbank
from roadlens.operators import features as feat
from roadlens.plans import oracle_base as O
from roadlens.sources.tables import incidents

TARGET = "requires_road_closure"


def scored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the closure composite (stage-2 subset) fitted on training rows."""
    inc = incidents(spark, sf_dir)
    base = inc.select("id", "ts", "start_datetime", "latitude", "longitude", "event_cause", "zone", "corridor",
                      "police_station", "status", "requires_road_closure", "is_train",
                      clean.coord_flag().alias("coord_out_of_bounds"),
                      clean.ts_parse_flag("start_datetime").alias("datetime_parse_failed"))
    ctx = feat.prepare_context(base)
    train = ctx.filter(F.col("is_train"))
    bank = statsbank.fit_bank(train, {"zone": ["zone"], "corridor": ["corridor"], "hour": ["hour"]},
                              {"y": F.col(TARGET).cast("double")})
    totals = bank["hour"].totals
    prior = totals["y"] / totals["n"] if totals["n"] else rates.global_mean(train, TARGET)

    def smooth(alpha, min_count=0):
        return statsbank.smoothed(alpha, prior, min_count)

    df = ctx.select("*", *events.cause_scores())
    df = statsbank.apply(df, bank["zone"], {"__z": smooth(10)})
    df = statsbank.apply(df, bank["corridor"], {"__c": smooth(20, 20)})
    df = statsbank.apply(df, bank["hour"], {"__h": F.col("y") / F.col("n")})
    df = df.select(*ctx.columns, "cause_severity_score", "cause_priority_score",
                   np_round(F.coalesce("__z", F.lit(prior)), 4).alias("zone_risk_score"),
                   np_round(F.coalesce("__c", F.lit(prior)), 4).alias("corridor_risk_score"),
                   F.coalesce("__h", F.lit(prior)).alias("hour_closure_rate_raw"))
    return df.withColumn("closure_risk_composite", feat.composite_risk())


def closure_hotspots(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    df = scored_incidents(spark, sf_dir).filter(F.col("coord_out_of_bounds") == 0)
    agg = df.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("status") != "RESOLVED").alias("n_active"),
        F.round(F.avg("closure_risk_composite"), 6).alias("avg_closure_risk"),
        F.max("closure_risk_composite").alias("max_closure_risk"),
        F.sum("datetime_parse_failed").alias("n_bad_timestamps"),
    )
    return agg.orderBy(F.col("avg_closure_risk").desc(), F.col("zone")).limit(top)


HOTSPOTS_SQL = O.with_prep(
    f"""
SELECT zone, count(*) AS n_events, count(*) FILTER (WHERE status <> 'RESOLVED') AS n_active,
       round(avg(comp), 6) AS avg_closure_risk, max(comp) AS max_closure_risk,
       CAST(sum(bad) AS BIGINT) AS n_bad_timestamps
FROM (
  SELECT p.zone, p.status,
         CASE WHEN try_cast(p.start_datetime AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END AS bad,
         round_even(0.40 * round_even({O.dmap('p.event_cause', CAUSE_SEVERITY, 0.083)}, 4)
                  + 0.25 * round_even({O.smoothed('zs', 10)}, 4)
                  + 0.20 * round_even({O.smoothed('cs', 20, 20)}, 4)
                  + 0.15 * coalesce(hs.m, g.gm), 4) AS comp
  FROM prep p CROSS JOIN g
  LEFT JOIN zs ON p.zone = zs.zone LEFT JOIN cs ON p.corridor = cs.corridor LEFT JOIN hs ON p.hour = hs.hour
  WHERE coalesce(p.latitude BETWEEN 12.5 AND 13.5 AND p.longitude BETWEEN 77.0 AND 78.0, false)
)
GROUP BY zone ORDER BY avg_closure_risk DESC, zone LIMIT 10""",
    zs=O.rate_cte(["zone"]), cs=O.rate_cte(["corridor"]), hs=O.rate_cte(["hour"]))


def nearest_junction_planar(lat="latitude", lon="longitude") -> tuple[Column, Column]:
    """GEO-05: planar nearest of the 8 named junctions (ties -> first), fallback 999 / City Centre."""
    arr = F.array(*[F.struct((F.sqrt(F.pow(F.col(lat) - F.lit(la), 2) + F.pow(F.col(lon) - F.lit(lo), 2))
                              * F.lit(111.0)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n"))
                    for i, (n, la, lo, _) in enumerate(JUNCTIONS)])
    best = F.array_min(arr)
    name = F.when(best["d"] < 999.0, best["n"]).otherwise(F.lit("City Centre"))
    return name, F.least(best["d"], F.lit(999.0))

