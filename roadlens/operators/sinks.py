"""Sinks (SNK-01..03, 06): partitioned Parquet/CSV writes, model + statistics
persistence with a JSON manifest, artifact bundles.  Paths default to a fresh
folder under the shared checkpoint directory (never a machine-local temp dir)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from roadlens.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> str:
    """SNK-01: processed train/test written once, partitioned by split (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy(split_col).format(fmt).option("header", True).save(path)
    return path


def save_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> str:
    """SNK-02: statistic tables as Parquet + a JSON manifest (type guard on reload)."""
    manifest = {"kind": "roadlens.fitted_state", "tables": sorted(tables), **(meta or {})}
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(
        f"{path}/_manifest")
    return path


def load_tables(spark: SparkSession, path: str, kind: str = "roadlens.fitted_state") -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    if manifest.get("kind") != kind:
        raise TypeError(f"{path} holds {manifest.get('kind')!r}, expected {kind!r}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def save_bundle(spark: SparkSession, model, features: list[str], metrics: dict, path: str,
                threshold: float = 0.35, version: str = "1.0.0") -> str:
    """SNK-03: model + feature list + metadata (version, metrics, threshold)."""
    model.write().overwrite().save(f"{path}/model")
    meta = {"kind": "roadlens.bundle", "version": version, "features": features, "threshold": threshold,
            "metrics": {k: (float(v) if v is not None else None) for k, v in metrics.items()}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load_bundle(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("kind") != "roadlens.bundle":
        raise TypeError("not a model bundle")
    return PipelineModel.load(f"{path}/model"), meta


def export_csv(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """SNK-06: one CSV folder per report table."""
    out = {}
    for name, t in tables.items():
        p = f"{path}/{name}"
        t.write.mode("overwrite").option("header", True).csv(p)
        out[name] = p
    return out


def row_counts(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    rows = []
    for name, p in paths.items():
        n = spark.read.option("header", True).format(fmt).load(p).count()
        rows.append((name, n))
    return spark.createDataFrame(rows, "table string, rows long")

