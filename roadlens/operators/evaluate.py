"""Classification metrics (EVL-01..06) as distributed aggregates.

AUC is exact and tie-aware without collecting scores: rows get exact global
positions by score (P1), each distinct score's mid-rank is an aggregate of those
positions, and the Mann-Whitney statistic is one more aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.operators.prefix import global_positions
from roadlens.operators.unpivot import melt


def confusion_metrics(df: DataFrame, label="label", pred="pred", by: list[str] = ()) -> DataFrame:
    """EVL-01: tn/fp/fn/tp, accuracy, precision, recall, F1 (0 on zero division),
    specificity, sensitivity — one conditional aggregate (optionally per ``by``)."""
    y, p = F.col(label), F.col(pred)
    g = df.groupBy(*by) if by else df.groupBy()
    c = g.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
              F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    prec, rec = div(tp, tp + fp), div(tp, tp + fn)
    return c.select(*by, "tn", "fp", "fn", "tp", div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
                    div(tn, tn + fp).alias("specificity"), rec.alias("sensitivity"))


def auc(df: DataFrame, label="label", score="score", key="id", by: list[str] = ()) -> DataFrame:
    """EVL-02: tie-aware ROC AUC (Mann-Whitney with mid-ranks), per ``by`` group."""
    by = list(by)
    pos = global_positions(df.select(*by, key, label, score), [score, key], by, out="__pos")
    per_score = pos.groupBy(*by, score).agg(
        ((F.min("__pos") + F.max("__pos")) / F.lit(2.0) + F.lit(1.0)).alias("__mid"),
        F.sum(F.col(label).cast("long")).alias("__np"), F.count(F.lit(1)).alias("__n"))
    s = per_score.groupBy(*by).agg(F.sum(F.col("__np") * F.col("__mid")).alias("__r"),
                                   F.sum("__np").alias("__p"), F.sum("__n").alias("__t"))
    p, n = F.col("__p").cast("double"), (F.col("__t") - F.col("__p")).cast("double")
    val = F.when((p == 0) | (n == 0), F.lit(None)).otherwise(
        (F.col("__r") - p * (p + F.lit(1.0)) / F.lit(2.0)) / (p * n))
    return s.select(*by, val.alias("auc"))


def roc_points(df: DataFrame, label="label", score="score", steps: int = 15) -> DataFrame:
    """EVL-03: TPR/FPR at thresholds i/(steps-1): counts per score bucket (partial
    aggregate), then a cumulative sum over at most ``steps`` bucket rows."""
    k = steps - 1
    b = F.least(F.greatest(F.floor(F.col(score) * F.lit(float(k))), F.lit(0)), F.lit(k)).cast("int")
    g = df.groupBy(b.alias("bucket")).agg(F.count_if(F.col(label) == 1).alias("np"),
                                          F.count_if(F.col(label) == 0).alias("nn"))
    spark = df.sparkSession
    grid = spark.range(0, steps).select(F.col("id").cast("int").alias("bucket"))
    j = grid.join(F.broadcast(g), "bucket", "left").fillna(0)
    w = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    return j.select((F.col("bucket") / F.lit(float(k))).alias("threshold"),
                    (F.sum("np").over(w) / F.sum("np").over(tot)).alias("tpr"),
                    (F.sum("nn").over(w) / F.sum("nn").over(tot)).alias("fpr"))


def fold_summary(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """EVL-04: mean and population std of each metric over folds."""
    long = melt(per_fold.select(*[F.col(m).cast("double").alias(m) for m in metrics]), metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def composite_ranking(results: DataFrame, metrics: list[str], model="model") -> DataFrame:
    """EVL-05: rank per metric (higher is better, ties share the best rank), sum, overall rank."""
    ranks = [F.rank().over(Window.orderBy(F.col(m).desc())).alias(f"rank_{m}") for m in metrics]
    r = results.select(model, *metrics, *ranks)
    total = sum((F.col(f"rank_{m}") for m in metrics), F.lit(0))
    r = r.withColumn("rank_sum", total)
    return r.withColumn("overall_rank", F.rank().over(Window.orderBy("rank_sum")))


def best_per_metric(results: DataFrame, metrics: list[str], model="model", k: int = 3) -> DataFrame:
    """EVL-06: top-k models per metric (unpivot + row_number per metric; ties by name)."""
    long = melt(results.select(model, *[F.col(m).cast("double").alias(m) for m in metrics]), metrics, "metric",
                "value", keep=[model])
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col(model))
    return long.select("metric", model, "value", F.row_number().over(w).alias("position")).filter(F.col("position") <= k)
