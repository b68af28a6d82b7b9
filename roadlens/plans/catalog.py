"""Query registry: SURVEY id (snake case) -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import time)."""
    import importlib
    for mod in ("q_core", "q_fitted", "q_dash", "q_select", "q_ml", "q_rules", "q_stream", "q_io"):
        try:
            importlib.import_module(f"roadlens.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"roadlens.plans.{mod}":
                raise
