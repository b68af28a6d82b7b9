"""Scans and sinks (SRC-01..04, SNK-01..03, 06): write derived data to the shared
scratch folder, scan it back with explicit schemas, compare with SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadlens.operators import dashboards as dash
from roadlens.operators import rates, sinks
from roadlens.operators import features as feat
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.sources import scans
from roadlens.sources.tables import incidents

_CSV_COLS = ["id", "start_datetime", "latitude", "longitude", "event_type", "authenticated", "veh_type", "corridor",
             "police_station", "gba_identifier", "zone", "junction", "description", "address", "requires_road_closure",
             "priority", "event_cause"]


@register("src_01", O.with_ctes(
    "SELECT CAST(id AS VARCHAR) AS id, start_datetime, latitude, longitude, veh_type, corridor, zone, "
    "requires_road_closure = 1 AS requires_road_closure, priority, event_cause FROM incidents"))
def src_01(spark, sf):
    inc = incidents(spark, sf).select(
        *[F.col(c).cast("string").alias(c) if c == "id" else
          (F.col(c) == 1).alias(c) if c == "requires_road_closure" else F.col(c) for c in _CSV_COLS])
    path = sinks.scratch(spark, "incident-csv")
    inc.write.mode("overwrite").option("header", True).csv(path)
    df = scans.scan_incident_csv(spark, path)
    return df.select("id", "start_datetime", "latitude", "longitude", "veh_type", "corridor", "zone",
                     "requires_road_closure", "priority", "event_cause")


@register("src_02", O.with_ctes(
    "SELECT CAST(id AS VARCHAR) AS id, start_datetime, event_cause, status FROM incidents"))
def src_02(spark, sf):
    inc = incidents(spark, sf).select(F.col("id").cast("string").alias("id"), "start_datetime", "latitude", "longitude",
                                      "event_cause", "description", "status")
    path = sinks.scratch(spark, "reports-json")
    inc.write.mode("overwrite").json(path)
    return scans.scan_reports(spark, path).select("id", "start_datetime", "event_cause", "status")


@register("src_03", O.with_ctes(
    "SELECT start_datetime, latitude, longitude, coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE event_cause END, 'others') "
    "AS event_cause, coalesce(description, '') AS description, CAST(30.0 AS DOUBLE) AS duration_mins, 2 AS num_lanes FROM incidents"))
def src_03(spark, sf):
    inc = incidents(spark, sf).select("start_datetime", "latitude", "longitude",
                                      F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("event_cause")).alias("event_cause"),
                                      "description")
    path = sinks.scratch(spark, "upload-csv")
    (inc.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).schema(
        "start_datetime string, latitude double, longitude double, event_cause string, description string").csv(path)
    out = scans.normalise_upload(df)
    return out.select("start_datetime", "latitude", "longitude", "event_cause",
                      F.coalesce("description", F.lit("")).alias("description"), "duration_mins",
                      F.col("num_lanes").cast("int").alias("num_lanes"))


@register("src_04", O.with_prep(
    f"SELECT p.id, {O.smoothed('t', 10)} AS zone_te, p.requires_road_closure FROM prep p CROSS JOIN g "
    "LEFT JOIN t ON p.zone = t.zone", t=O.rate_cte(["zone"])))
def src_04(spark, sf):
    ctx = feat.prepare_context(incidents(spark, sf))
    train = ctx.filter("is_train")
    prior = rates.global_mean(train, "requires_road_closure")
    x = feat.rate_feature(ctx.select("id", "zone"), train, ["zone"], "requires_road_closure", "zone_te", 10, prior,
                          digits=None)
    fpath, tpath = sinks.scratch(spark, "features"), sinks.scratch(spark, "target")
    x.select("id", "zone_te").write.mode("overwrite").parquet(fpath)
    ctx.select("id", "requires_road_closure").write.mode("overwrite").parquet(tpath)
    return scans.scan_handoff(spark, fpath, tpath)


@register("snk_01", O.with_ctes(
    "SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, count(*) AS rows, CAST(sum(requires_road_closure) AS BIGINT) AS positives "
    "FROM incidents GROUP BY 1"))
def snk_01(spark, sf):
    inc = incidents(spark, sf).select("id", "requires_road_closure",
                                      F.when(F.col("is_train"), "train").otherwise("test").alias("split"))
    path = sinks.write_splits(inc, sinks.scratch(spark, "splits"))
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("requires_road_closure").alias("positives"))


@register("snk_02", O.with_ctes(
    "SELECT i.id, true AS identical, round(a.m, 6) AS avg_duration FROM incidents i LEFT JOIN "
    "(SELECT num_lanes, avg(duration_mins) AS m FROM incidents WHERE is_train GROUP BY 1) a USING (num_lanes)"))
def snk_02(spark, sf):
    """Persist + reload fitted state (statistics tables and an ML pipeline); transform equals."""
    inc = incidents(spark, sf).select("id", "is_train", "duration_mins", "num_lanes", F.hour("ts").cast("double").alias("hr"))
    train = inc.filter("is_train")
    pipe = Pipeline(stages=[Imputer(inputCols=["hr"], outputCols=["hr_i"], strategy="median"),
                            VectorAssembler(inputCols=["duration_mins", "num_lanes", "hr_i"], outputCol="v"),
                            StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True)]).fit(train)
    path = sinks.scratch(spark, "pipeline")
    pipe.write().overwrite().save(f"{path}/pipeline")
    stats = train.groupBy("num_lanes").agg(F.avg("duration_mins").alias("avg_duration"))
    sinks.save_tables(spark, {"lane_stats": stats}, f"{path}/state", {"fitted_on_rows": train.count()})
    from pyspark.ml import PipelineModel
    reloaded = PipelineModel.load(f"{path}/pipeline")
    state = sinks.load_tables(spark, f"{path}/state")
    a = pipe.transform(inc).select("id", vector_to_array("z").alias("za"))
    b = reloaded.transform(inc).select("id", vector_to_array("z").alias("zb"))
    lanes = inc.select("id", "num_lanes").join(state["lane_stats"], "num_lanes", "left")
    j = a.join(b, "id").join(lanes, "id")
    return j.select("id", (F.col("za") == F.col("zb")).alias("identical"), F.round("avg_duration", 6).alias("avg_duration"))


@register("snk_03")
def snk_03(spark, sf):
    """Artifact bundle: raw-feature pipeline + features + test metrics; reload and score the test rows."""
    from pyspark.ml.classification import LogisticRegression

    from roadlens.operators import train as tr
    from roadlens.plans.q_select import FEATURES, LABEL, feature_matrix
    rows = feature_matrix(spark, sf).select(
        "id", F.col(LABEL).cast("int").alias("label"), (F.col("id") % 5 != 0).alias("is_train"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
    train, test = rows.filter("is_train"), rows.filter(~F.col("is_train"))
    weights = tr.class_weights(train.select("label")).select("label", "weight")     # one row per class
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=200)
                            ]).fit(train.join(F.broadcast(weights), "label"))
    metrics = tr.metrics(tr.predictions(pipe, test, threshold=0.35))
    path = sinks.scratch(spark, "bundle")
    sinks.save_bundle(spark, pipe, FEATURES, {k: float(metrics[k] or 0) for k in ("auc", "f1", "recall", "precision", "accuracy")}, path)
    model, meta = sinks.load_bundle(spark, path)
    out = tr.predictions(model, test, threshold=meta["threshold"])
    return out.select("id", "pred", F.lit(meta["version"]).alias("version"),
                      F.round(F.lit(float(meta["metrics"]["auc"])), 6).alias("test_auc"))


def _export_counts_sql():
    from roadlens.plans.catalog import ORACLES
    from roadlens.plans.q_dash import with_dash
    weekly = ORACLES["agg_12"]
    return with_dash(f"""
SELECT 'zones' AS "table", count(DISTINCT zone) AS rows FROM d UNION ALL SELECT 'junctions', count(DISTINCT nearest_junction) FROM d
UNION ALL SELECT 'causes', count(DISTINCT event_cause) FROM d UNION ALL SELECT 'kpis', 1
UNION ALL SELECT 'weekly', count(*) FROM ({weekly})""")


@register("snk_06", _export_counts_sql())
def snk_06(spark, sf):
    """Multi-table CSV export (zone, junction, cause, KPI, weekly trend) and read-back row counts."""
    from roadlens.plans.q_dash import dash_scored
    b = dash_scored(spark, sf)
    tables = {"zones": dash.zone_congestion(b), "junctions": dash.junction_table(b),
              "causes": dash.distribution(b.select("event_cause"), "event_cause"), "kpis": dash.kpi_counts(b),
              "weekly": dash.weekly_trend(b)}
    paths = sinks.export_csv(tables, sinks.scratch(spark, "export"))
    return sinks.row_counts(spark, paths)
