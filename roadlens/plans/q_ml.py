"""Model lab, explanation, refinement, isolation forest, stage-1 pipeline (MDL, TUN, XPL,
RFN, SEL-05/06, SCR-01, OUT-04/05, INT-04).  Model outputs have no SQL twin, so
except MDL-01 these are rows-only checks; their building blocks (AUC, folds,
confusion metrics, scoring tiers) are oracle-checked elsewhere."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadlens.functions import geo, temporal
from roadlens.operators import bagging, clean, encode, forest, impute, lab, score
from roadlens.operators import explain as xp
from roadlens.operators import train as tr
from roadlens.operators.iforest import fit_isolation_forest
from roadlens.operators.outliers import FenceModel, StandardScalerModel, method_comparison
from roadlens.operators.prefix import stratified_folds
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.q_select import FEATURES, LABEL, THRESHOLD, feature_matrix
from roadlens.sources.tables import incidents

def matrix(spark, sf):
    """The feature matrix with the split flag (a function of the id, so no join is needed)."""
    return feature_matrix(spark, sf).withColumn("is_train", F.col("id") % 5 != 0)


def vectors(spark, sf, features=FEATURES):
    """(train, test) for pyspark.ml: assembled vectors, weights and folds."""
    fm = matrix(spark, sf)
    return (tr.prepare(fm.filter("is_train"), features, LABEL),
            tr.prepare(fm.filter(~F.col("is_train")), features, LABEL))


def lab_rows(spark, sf, features=FEATURES):
    """id, label, fold (0 to 4: training rows, -1: test rows), x: the matrix once, cut."""
    from roadlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    x = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features]).alias("x")
    rows = matrix(spark, sf).select("id", "is_train", F.col(LABEL).cast("int").alias("label"), x)
    train = stratified_folds(rows.filter("is_train"), "label", "id", k=5)
    test = rows.filter(~F.col("is_train")).withColumn("fold", F.lit(lab.TEST))
    cols = ["id", "label", "fold", "x"]
    return train.select(*cols).unionByName(test.select(*cols)).checkpoint(eager=True)


WIDTH = len(FEATURES)


@register("mdl_01", O.with_ctes(
    "SELECT requires_road_closure, n_c, n / (k * n_c) AS weight, neg / pos AS pos_weight_ratio FROM "
    "(SELECT requires_road_closure, count(*) AS n_c FROM incidents WHERE is_train GROUP BY 1), "
    "(SELECT count(*) AS n, count(DISTINCT requires_road_closure) AS k, count(*) FILTER (WHERE requires_road_closure = 1) AS pos, "
    "count(*) FILTER (WHERE requires_road_closure = 0) AS neg FROM incidents WHERE is_train)"))
def mdl_01(spark, sf):
    inc = incidents(spark, sf).filter("is_train").select(LABEL)
    return tr.class_weights(inc, LABEL)


def _model_query(name):
    def q(spark, sf):
        train, test = vectors(spark, sf)
        model = tr.estimators(train.count())[name].fit(train)
        return tr.predictions(model, test)
    q.__name__ = name
    return q


for _id, _name in [("mdl_02", "logistic_regression"), ("mdl_03", "decision_tree")]:
    register(_id)(_model_query(_name))


def arrays(rows):
    """``vectors``' rows for the forests that hold theirs as arrays."""
    return rows.select("id", "label", vector_to_array("features", "float32").alias("x"))


def _large_forest(estimator, train):
    """Node table and class weights of the estimator's forest, the rows dealt over tasks."""
    return bagging.fit(arrays(train), WIDTH, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed())


@register("mdl_04")
def mdl_04(spark, sf):
    train, test = vectors(spark, sf)
    n = train.count()
    estimator = tr.estimators(n)["random_forest"]
    if n <= lab.TASK_ROWS:
        return tr.predictions(estimator.fit(train), test)
    p = forest.score(arrays(test), *_large_forest(estimator, train), WIDTH)
    return p.select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


@register("mdl_05")
def mdl_05(spark, sf):
    """Second-order boosting: margins, probability and 0.5 decision of the test rows."""
    return lab.predictions(lab_rows(spark, sf), lab.Fit("newton_boosting"), WIDTH)


def _extra_trees(spark, sf, rows):
    """Node table and class weights of the extra trees, the reference's production model."""
    return forest.fit(rows, WIDTH, {})


@register("mdl_06")
def mdl_06(spark, sf):
    rows = lab_rows(spark, sf)
    nodes, weight = _extra_trees(spark, sf, rows)
    p = forest.score(rows.filter(f"fold = {lab.TEST}"), nodes, weight, WIDTH)
    return p.select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


@register("mdl_07")
def mdl_07(spark, sf):
    return lab.compare(lab_rows(spark, sf), WIDTH)


@register("scr_01")
def scr_01(spark, sf):
    train, test = vectors(spark, sf)
    model = tr.estimators(train.count())["logistic_regression"].fit(train)
    p = tr.predictions(model, test, threshold=THRESHOLD)
    return p.select("id", F.round("score", 6).alias("probability_closure"), "pred",
                    score.risk_tier("score").alias("risk_level"), score.confidence_tier("score").alias("confidence"))


@register("sel_05")
def sel_05(spark, sf):
    train, _ = vectors(spark, sf)
    n = train.count()
    estimator = tr.estimators(n)["random_forest"].setNumTrees(200).setMaxDepth(8)
    if n <= lab.TASK_ROWS:
        return xp.impurity_importance(estimator.fit(train), FEATURES, spark)
    nodes, weight = _large_forest(estimator, train)
    return xp.forest_importance(bagging.split_trees(nodes), weight, FEATURES)


@register("sel_06")
def sel_06(spark, sf):
    """Drop of the AUC of extra trees on the test rows, 10 permutations of each feature."""
    rows = lab_rows(spark, sf)
    nodes, weight = _extra_trees(spark, sf, rows)
    return xp.permutation_importance(rows.filter(f"fold = {lab.TEST}"), xp.forest_predictor(nodes, weight), FEATURES, repeats=10)


# The models whose whole search (60 draws, 3 objectives, 5 folds, then the grids) ends within the
# sweep; ``lab.search`` takes all seven (README has what the others cost).
SEARCHED = ("logistic_regression", "decision_tree")


def _search(spark, sf, grids=True):
    rows = lab_rows(spark, sf)
    return rows, lab.search(rows, WIDTH, SEARCHED, grids=grids, checkpoint=lambda df: df.checkpoint(eager=True))


@register("tun_01")
def tun_01(spark, sf):
    return _search(spark, sf, grids=False)[1]


@register("tun_02")
def tun_02(spark, sf):
    return _search(spark, sf)[1].filter(F.col("search") == "grid")


@register("tun_03")
def tun_03(spark, sf):
    rows, found = _search(spark, sf)
    return tr.improvement_table(found, lab.baselines(rows, WIDTH, SEARCHED))


@register("tun_04")
def tun_04(spark, sf):
    return tr.best_params(_search(spark, sf)[1])


@register("tun_05")
def tun_05(spark, sf):
    return tr.top_models(lab.compare(lab_rows(spark, sf), WIDTH))


@register("xpl_01")
def xpl_01(spark, sf):
    nodes, weight = _extra_trees(spark, sf, lab_rows(spark, sf))
    return xp.forest_importance(nodes, weight, FEATURES)


def _tree_shap(spark, sf):
    """The extra trees and the Shapley values of all test rows."""
    rows = lab_rows(spark, sf)
    nodes, weight = _extra_trees(spark, sf, rows)
    return rows, nodes, weight, xp.tree_shap(rows.filter(f"fold = {lab.TEST}"), nodes, weight, FEATURES).checkpoint(eager=True)


@register("xpl_02")
def xpl_02(spark, sf):
    return _tree_shap(spark, sf)[-1]


@register("xpl_02_linear")
def xpl_02_linear(spark, sf):
    train, _ = vectors(spark, sf)
    model = tr.estimators(train.count())["logistic_regression"].fit(train)
    return xp.linear_shap(model, matrix(spark, sf).filter(~F.col("is_train")), FEATURES)


@register("xpl_03")
def xpl_03(spark, sf):
    return xp.mean_abs_shap(_tree_shap(spark, sf)[-1])


@register("xpl_04")
def xpl_04(spark, sf):
    return xp.pick_cases(mdl_06(spark, sf))


@register("xpl_05")
def xpl_05(spark, sf):
    _, nodes, weight, shap = _tree_shap(spark, sf)
    return xp.additive_explanation(shap, xp.forest_base(nodes, weight)).withColumnRenamed("predicted_logit", "predicted")


def _influence(spark, sf, repeats=20):
    """Impurity, SHAP and permutation importance of one model: the extra trees."""
    rows, nodes, weight, shap = _tree_shap(spark, sf)
    perm = xp.permutation_importance(rows.filter(f"fold = {lab.TEST}"), xp.forest_predictor(nodes, weight), FEATURES, repeats, keep=True)
    return rows, xp.influence_table(xp.forest_importance(nodes, weight, FEATURES), xp.mean_abs_shap(shap), perm)


@register("xpl_06")
def xpl_06(spark, sf):
    return _influence(spark, sf)[1]


@register("rfn_01")
def rfn_01(spark, sf):
    return xp.weak_features(_influence(spark, sf)[1])


@register("rfn_02")
def rfn_02(spark, sf):
    """All models on all features and on those that are left: each test metric and its change."""
    rows, table = _influence(spark, sf)
    weak = {r["feature"] for r in xp.weak_features(table).filter("drop").collect()}      # feature names
    kept = [i for i, f in enumerate(FEATURES) if f not in weak] or list(range(WIDTH))
    pruned = rows.withColumn("x", F.array(*[F.col("x")[i] for i in kept]))
    five = ("auc", "f1", "recall", "precision", "accuracy")
    def test_metrics(df, width, name):
        fits = [lab.Fit(m) for m in lab.MODELS]
        got = lab.run(df, fits, width).filter("held = 'held_out'").join(F.broadcast(lab.described(fits, spark)), "fit")
        return got.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in five])).alias("v")).select("model", "v.*")
    both = test_metrics(rows, WIDTH, "baseline").join(test_metrics(pruned, len(kept), "pruned"), ["model", "metric"])
    return both.withColumn("delta", F.col("pruned") - F.col("baseline"))


# Validation curves of these end within the sweep; ``lab.validation_curves`` takes all eight (README: what the others cost).
CURVED = ("logistic_regression", "decision_tree", "random_forest", "extra_trees", "gradient_boosting")


@register("rfn_03")
def rfn_03(spark, sf):
    g = lab.learning_curves(lab_rows(spark, sf), WIDTH)
    last = g.filter("fraction = 1").select("model", xp.diagnosis(F.col("train_mean"), F.col("val_mean")).alias("diagnosis"))
    return g.withColumn("gap", F.col("train_mean") - F.col("val_mean")).join(last, "model")


@register("rfn_04")
def rfn_04(spark, sf):
    return lab.validation_curves(lab_rows(spark, sf), WIDTH, CURVED)


@register("rfn_05")
def rfn_05(spark, sf):
    """All models; the diagnosis is that of a learning curve's last point (all training rows of each fold)."""
    rows = lab_rows(spark, sf)
    scores = lab.fold_scores(rows, WIDTH).checkpoint(eager=True)
    last = lab.last_points(scores)
    curves = last.select("model", xp.diagnosis(F.col("train_mean"), F.col("val_mean")).alias("diagnosis"))
    return xp.final_selection(lab.summary(scores), curves)


# ------------------------------------------------------------------ isolation forest + stage 1

IF_COLS = ["latitude", "longitude", "duration_mins", "num_lanes", "hour"]


def _if_frame(spark, sf):
    inc = incidents(spark, sf)
    return inc.select("id", "is_train", "latitude", "longitude", "duration_mins", "num_lanes",
                      temporal.hour_of("ts").alias("hour"))


@register("out_04")
def out_04(spark, sf):
    df = _if_frame(spark, sf)
    model = fit_isolation_forest(df.filter("is_train"), IF_COLS)
    return model.transform(df.select("id", *IF_COLS)).select("id", "if_anomaly", "if_anomaly_score")


@register("out_05")
def out_05(spark, sf):
    df = _if_frame(spark, sf)
    train = df.filter("is_train")
    model = fit_isolation_forest(train, IF_COLS)
    fences = FenceModel.fit(train, ["duration_mins", "latitude", "longitude"])
    flagged = model.transform(fences.flags(df.select("id", *IF_COLS)))
    return method_comparison(flagged, ["duration_mins", "latitude", "longitude"])


@register("int_04")
def int_04(spark, sf):
    """Stage-1 fit on training rows, transform all rows: clean -> impute -> datetime/geo ->
    IQR flags -> isolation forest -> label encode -> standard scale."""
    inc = incidents(spark, sf)
    cats = ["veh_type", "corridor", "zone", "gba_identifier", "junction", "police_station", "event_type"]
    base = clean.clean(inc.select("id", "is_train", "start_datetime", "ts", "latitude", "longitude", "duration_mins",
                                  "num_lanes", *cats, "description"), dedup=False)
    base = impute.constant_impute(base, cats, overrides={"corridor": "unknown_corridor"})
    base = impute.text_impute(base, ["description"])
    base = base.select("*", *temporal.cyclical("ts"), *temporal.calendar_parts("ts"), *temporal.peak_flags("ts"),
                       *geo.anchor_distances(), *geo.nearest_anchor())
    train = base.filter("is_train")
    num = ["duration_mins", "num_lanes"]
    fences = FenceModel.fit(train, num)
    x = fences.flags(base)
    model = fit_isolation_forest(train, ["latitude", "longitude", "duration_mins", "num_lanes", "hour"])
    x = model.transform(x)
    x = encode.label_encode(x, train, cats)
    scaler = StandardScalerModel.fit(train, num + ["dist_to_nearest_junction"])
    x = scaler.transform(x)
    return x.drop("ts", "start_datetime", "description", *cats)

