"""Categorical encoders (ENC-01..04): fit = one aggregate per column, transform = lookup join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.operators import rates
from roadlens.operators.unpivot import melt


def label_table(train: DataFrame, column: str, max_local: int = 50_000) -> DataFrame:
    """ENC-01 fit: sorted distinct non-NULL values -> code 0..k-1.

    A bounded category set (checked by taking at most ``max_local + 1`` distinct
    values) is coded locally and becomes a small relation; a larger one gets exact
    positions from the distributed prefix count (P1), never a one-task window."""
    from roadlens.operators.prefix import global_positions
    d = train.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    rows = d.take(max_local + 1)
    if len(rows) <= max_local:
        vals = sorted(r["value"] for r in rows)
        return train.sparkSession.createDataFrame([(v, i) for i, v in enumerate(vals)],
                                                  T.StructType([d.schema["value"], T.StructField("code", T.LongType())]))
    return global_positions(d, ["value"], out="code")


def label_encode(df: DataFrame, train: DataFrame, columns: list[str], unseen: int = -1,
                 strict: bool = False) -> DataFrame:
    """ENC-01 transform: ``{c}_label``; unseen -> -1, or an error in strict mode."""
    out = df
    for c in columns:
        t = label_table(train, c).withColumnRenamed("code", f"{c}_label")
        out = rates.lookup(out, t, {c: "value"}, {f"{c}_label": unseen})
        if strict:
            out = out.withColumn(f"{c}_label", F.when(F.col(f"{c}_label") == unseen,
                                                      F.raise_error(F.lit(f"unseen category in {c}")))
                                 .otherwise(F.col(f"{c}_label")))
    return out


def frequency_encode(df: DataFrame, train: DataFrame, columns: list[str], unseen: str = "zero") -> DataFrame:
    """ENC-02: share of non-NULL training rows; unseen -> 0 or 1/n_unique."""
    out = df
    for c in columns:
        nn = train.filter(F.col(c).isNotNull())
        t = rates.share_table(nn, [c], out=f"{c}_freq")
        if unseen == "zero":
            default = 0.0
        else:
            default = 1.0 / max(1, nn.select(c).distinct().count())
        out = rates.lookup(out, t, [c], {f"{c}_freq": default})
    return out


def target_encode(df: DataFrame, train: DataFrame, columns: list[str], target: str, alpha: float = 10.0,
                  prior: float | None = None) -> DataFrame:
    """ENC-03: ``(n*mean + alpha*G)/(n + alpha)``; unseen -> G."""
    g = rates.global_mean(train, target) if prior is None else prior
    out = df
    for c in columns:
        t = rates.smoothed_rate_table(train, [c], target, alpha, g, out=f"{c}_te")
        out = rates.lookup(out, t, [c], {f"{c}_te": g})
    return out


def encoder_comparison(train: DataFrame, columns: list[str], target: str, alpha: float = 10.0) -> DataFrame:
    """ENC-04: per (feature, category): count, label code, frequency code, target code,
    target mean; sorted feature asc, count desc.  Categoricals are unpivoted once and
    aggregated in one groupBy(feature, category)."""
    g = rates.global_mean(train, target)
    long = melt(train.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(target).cast("double").alias("__y")),
                columns, "feature", "category", keep=["__y"]).filter(F.col("category").isNotNull())
    st = long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("count"), F.avg("__y").alias("target_mean"))
    tot = Window.partitionBy("feature")
    return (st.select("feature", "category", "count",
                      (F.dense_rank().over(Window.partitionBy("feature").orderBy("category")) - 1).alias("label_code"),
                      (F.col("count") / F.sum("count").over(tot)).alias("frequency_code"),
                      ((F.col("count") * F.col("target_mean") + F.lit(alpha * g)) / (F.col("count") + F.lit(alpha)))
                      .alias("target_code"),
                      "target_mean")
            .orderBy("feature", F.col("count").desc(), "category"))
