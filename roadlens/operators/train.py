"""pyspark.ml models (MDL-01..04, SCR-01).

Training data is a cached, slim (id, label, weight, fold, features-vector) frame:
every estimator and every fold reads the same assembled vectors.  Folds come
from the stratified P1 fold column (SPL-02), so CV is reproducible under retries.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators import evaluate as ev
from roadlens.operators.prefix import stratified_folds

SEED = 42


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """MDL-01: balanced weights n / (k * n_c) per class, plus the neg/pos ratio."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"),
                F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("pos"),
                F.sum(F.when(F.col(label) == 0, F.col("n_c"))).alias("neg"))
    return c.crossJoin(tot).select(label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"),
                                   (F.col("neg") / F.col("pos")).alias("pos_weight_ratio"))


def prepare(df: DataFrame, features: list[str], label: str, key: str = "id", folds: int = 5) -> DataFrame:
    """Assemble vectors once (NULL -> 0), attach balanced weights and folds, cache."""
    base = df.select(key, F.col(label).cast("int").alias("label"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    w = class_weights(base)
    base = base.join(F.broadcast(w.select("label", "weight")), "label")
    base = stratified_folds(base, "label", key, k=folds)
    vec = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(base)
    return vec.select(key, "label", "weight", "fold", "features").persist(StorageLevel.MEMORY_AND_DISK)


def estimators(n_rows: int) -> dict:
    """The comparison set (parameters follow the reference where Spark has them).

    logistic regression: L2, C = 1 -> regParam = 1 / (C * n), standardised inputs.  Extra trees are
    in ``forest``, the boosted models in ``lab``.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=1000,
                            regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0)
    return {
        "logistic_regression": Pipeline(stages=[scaler, lr]),
        "decision_tree": DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=8,
                                                minInstancesPerNode=10, seed=SEED),
        "random_forest": RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=300, maxDepth=10,
                                                minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=SEED),
    }


def predictions(model, df: DataFrame, key: str = "id", threshold: float = 0.5) -> DataFrame:
    """Probability of class 1 and the label at a threshold: 0.5 in the lab, as a model's own
    prediction; batch scoring (SCR-01) passes the decision threshold 0.35."""
    p = model.transform(df)
    prob = vector_to_array(F.col("probability"))[1]
    return p.select(key, "label", prob.alias("score"), (prob >= threshold).cast("int").alias("pred"))


def metrics(pred: DataFrame, key: str = "id") -> dict:
    """Confusion metrics (one aggregate) + ROC AUC from Spark's evaluator with
    ``numBins=0`` (exact over all distinct scores, tie-aware; cross-checked against
    ``evaluate.auc`` in the tests).  Used inside CV/tuning loops where the
    checkpointed exact-position AUC would add a write per fold."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    m = ev.confusion_metrics(pred).first().asDict()
    counts = (m["tp"] + m["fn"], m["tn"] + m["fp"])
    if min(counts) == 0:
        m["auc"] = None
    else:
        m["auc"] = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                                 numBins=0).evaluate(pred.select(F.col("score").cast("double"),
                                                                                 F.col("label").cast("double")))
    return m


def improvement_table(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """TUN-03: best of the two searches vs baseline per (model, objective): delta and
    pct change (1e-9 guard), sorted objective asc, delta desc."""
    best = results.groupBy("model", "objective").agg(F.max("cv_score").alias("tuned"))
    j = best.join(baseline, ["model", "objective"])
    return (j.select("model", "objective", "baseline", "tuned", (F.col("tuned") - F.col("baseline")).alias("delta"),
                     ((F.col("tuned") - F.col("baseline")) / F.greatest(F.abs("baseline"), F.lit(1e-9)) * 100)
                     .alias("pct_change"))
            .orderBy("objective", F.col("delta").desc()))


def best_params(results: DataFrame) -> DataFrame:
    """TUN-04: best setting per (model, objective) via max(struct(score, params))."""
    g = results.groupBy("model", "objective").agg(F.max(F.struct("cv_score", "params", "search")).alias("b"))
    return g.select("model", "objective", F.col("b.cv_score").alias("cv_score"), F.col("b.params").alias("params"),
                    F.col("b.search").alias("search"))


def top_models(comparison: DataFrame, n: int = 3) -> DataFrame:
    """TUN-05: top-n models by CV AUC."""
    return comparison.orderBy(F.col("cv_auc_mean").desc_nulls_last(), "model").limit(n)
