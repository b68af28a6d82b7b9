"""Imputation and missingness reports (IMP-01..07)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.constants import CATEGORICAL_FILL


@dataclass
class MedianImputerModel:
    """IMP-01 state: one median per column + which columns had NULLs at fit."""
    medians: dict
    had_missing: dict
    add_indicator: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.medians:
                out.append(F.coalesce(F.col(c), F.lit(self.medians[c])).alias(c))
            else:
                out.append(F.col(c))
        ind = [F.col(c).isNull().cast("int").alias(f"{c}_was_missing")
               for c in self.medians if self.add_indicator and self.had_missing.get(c)]
        return df.select(*out, *ind)


def fit_median_imputer(train: DataFrame, columns: list[str], add_indicator: bool = True,
                       exact: bool = True) -> MedianImputerModel:
    """Medians of all columns: exact by distributed selection (P1, linear interpolation
    as pandas) or ``percentile_approx`` with a high accuracy."""
    from roadlens.operators.prefix import quantile_row
    med = quantile_row(train, columns, [0.5], exact=exact)
    row = train.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns]).first()
    return MedianImputerModel({c: med[(c, 0.5)] for c in columns},
                              {c: row[f"n_{c}"] > 0 for c in columns}, add_indicator)


def constant_impute(df: DataFrame, columns: list[str], overrides: dict | None = None,
                    add_indicator: bool = True) -> DataFrame:
    """IMP-02: override map else ``unknown_{col}``; optional ``{col}_was_missing``."""
    fills = {**CATEGORICAL_FILL, **(overrides or {})}
    sel = [F.coalesce(F.col(c), F.lit(fills.get(c, f"unknown_{c}"))).alias(c) if c in columns else F.col(c)
           for c in df.columns]
    ind = [F.col(c).isNull().cast("int").alias(f"{c}_was_missing") for c in columns] if add_indicator else []
    return df.select(*sel, *ind)


def fit_mode(train: DataFrame, columns: list[str]) -> dict:
    """IMP-03 fit: most frequent value, ties -> smallest; all-NULL -> ``unknown``.

    Distributed (``mode_table``): counts per (column, value) are partial aggregates and
    the pick is a min over (-count, value) per column, so no task ever holds all the
    distinct values of a column; only one row per column reaches the driver."""
    rows = mode_table(train, columns).collect()
    return {r["column"]: r["mode_value"] for r in rows}


def mode_table(train: DataFrame, columns: list[str]) -> DataFrame:
    """IMP-03 as a distributed table (column, mode): count per (column, value) after
    one unpivot, then the best (count desc, value asc) per column."""
    from roadlens.operators.unpivot import melt
    long = melt(train.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns, "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("b"))
    cols = train.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return cols.join(best, "column", "left").select(
        "column", F.coalesce(F.col("b.value"), F.lit("unknown")).alias("mode_value"))


def mode_impute(df: DataFrame, modes: dict) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(modes[c])).alias(c) if c in modes else F.col(c)
                       for c in df.columns])


def text_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """IMP-04: NULL text -> ''."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def missing_counts(df: DataFrame, label: str) -> DataFrame:
    """NULL count per column as a long table (column, <label>): one aggregate + stack."""
    from roadlens.operators.unpivot import melt
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return melt(wide, df.columns, "column", label)


def missing_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """IMP-05: per column NULLs before vs after (columns of either frame)."""
    b = missing_counts(before, "missing_before")
    a = missing_counts(after, "missing_after")
    return (b.join(a, "column", "full_outer")
            .select("column", F.coalesce("missing_before", F.lit(0)).alias("missing_before"),
                    F.coalesce("missing_after", F.lit(0)).alias("missing_after"))
            .withColumn("resolved", F.col("missing_before") - F.col("missing_after")))


def feature_summary(df: DataFrame) -> DataFrame:
    """IMP-06: row count, column count, columns per Spark type, total NULL cells."""
    types: dict[str, int] = {}
    for _, t in df.dtypes:
        types[t] = types.get(t, 0) + 1
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("null_cells"))
    spark = df.sparkSession
    t = spark.createDataFrame([(k, v) for k, v in sorted(types.items())], "dtype string, n_columns int")
    return agg.crossJoin(t).select(F.col("rows"), F.lit(len(df.columns)).alias("columns"), "dtype",
                                   "n_columns", F.coalesce(F.col("null_cells"), F.lit(0)).alias("null_cells"))
