"""IQR fences, outlier flags, winsorising, method comparison, scalers (OUT-01..03, 05; SCL-01/02)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators.prefix import exact_quantiles
from roadlens.operators.unpivot import melt


def iqr_fences(train: DataFrame, columns: list[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """OUT-01: (column, q1, q3, iqr, lower, upper).

    Exact quantiles come from the distributed P1 selection (one range shuffle of the
    values, no per-task value buffer); ``exact=False`` uses ``percentile_approx``."""
    if exact:
        q = exact_quantiles(train, columns, [0.25, 0.75])
        wide = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
                                       F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    else:
        aggs = [F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], 100000).alias(c) for c in columns]
        arr = melt(train.agg(*aggs), columns, "column", "qs")
        wide = arr.select("column", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return wide.select("column", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - F.lit(k) * iqr).alias("lower"),
                       (F.col("q3") + F.lit(k) * iqr).alias("upper"))


@dataclass
class FenceModel:
    fences: dict  # column -> (lower, upper)

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], k: float = 1.5, exact: bool = True) -> "FenceModel":
        rows = iqr_fences(train, columns, k, exact).collect()   # one row per column
        return cls({r["column"]: (r["lower"], r["upper"]) for r in rows})

    def flags(self, df: DataFrame) -> DataFrame:
        """OUT-02: ``{c}_iqr_outlier`` = value outside [lower, upper]; NULL -> 0."""
        return df.select("*", *[F.coalesce(((F.col(c) < lo) | (F.col(c) > hi)), F.lit(False)).cast("int")
                                .alias(f"{c}_iqr_outlier") for c, (lo, hi) in self.fences.items()])

    def winsorise(self, df: DataFrame) -> DataFrame:
        """OUT-03: clip to the fences; NULL stays NULL (Spark's least/greatest skip NULLs)."""
        sel = []
        for c in df.columns:
            if c in self.fences:
                lo, hi = self.fences[c]
                v = F.col(c)
                sel.append(F.when(v.isNull(), F.lit(None))
                           .otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi))).alias(c))
            else:
                sel.append(F.col(c))
        return df.select(*sel)


def method_comparison(flags: DataFrame, columns: list[str], if_flag: str = "if_anomaly") -> DataFrame:
    """OUT-05: per column IQR count, IF count, overlap and percentages, sorted by IQR count desc."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n"), F.sum(F.col(if_flag)).alias("__if")]
    for c in columns:
        aggs += [F.sum(F.col(f"{c}_iqr_outlier")).alias(f"iqr__{c}"),
                 F.sum(F.col(f"{c}_iqr_outlier") * F.col(if_flag)).alias(f"both__{c}")]
    wide = flags.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"iqr__{c}").alias("iqr_count"),
                     F.col(f"both__{c}").alias("overlap")) for c in columns]
    long = wide.select("__n", "__if", F.explode(F.array(*rows)).alias("r")).select("__n", "__if", "r.*")
    return (long.select("column", F.col("iqr_count").cast("long").alias("iqr_count"),
                        F.col("__if").cast("long").alias("if_count"), F.col("overlap").cast("long").alias("overlap"),
                        F.round(F.col("iqr_count") / F.col("__n") * 100, 4).alias("iqr_pct"),
                        F.round(F.col("__if") / F.col("__n") * 100, 4).alias("if_pct"))
            .orderBy(F.col("iqr_count").desc(), "column"))


@dataclass
class StandardScalerModel:
    """SCL-01: population standard deviation; zero variance -> scale 1."""
    stats: dict  # column -> (mean, std)

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> "StandardScalerModel":
        row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        return cls({c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        sel = []
        for c in df.columns:
            if c in self.stats:
                m, s = self.stats[c]
                sel.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
            else:
                sel.append(F.col(c))
        return df.select(*sel)


@dataclass
class MinMaxModel:
    """SCL-02: (x - min) / (max - min); constant column -> 0."""
    stats: dict

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> "MinMaxModel":
        row = train.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
        return cls({c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        sel = []
        for c in df.columns:
            if c in self.stats:
                lo, hi = self.stats[c]
                rng = (hi - lo) if hi is not None and lo is not None and hi != lo else None
                sel.append(((F.col(c) - F.lit(lo)) / F.lit(rng)).alias(c) if rng else F.lit(0.0).alias(c))
            else:
                sel.append(F.col(c))
        return df.select(*sel)
