"""P5: wide -> long with ``unpivot`` (an Expand node: one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def melt(df: DataFrame, columns: list[str], name_col: str = "column", value_col: str = "value",
         keep: list[str] = ()) -> DataFrame:
    """Unpivot ``columns`` into (name, value) rows, carrying the ``keep`` columns."""
    return df.unpivot(list(keep), list(columns), name_col, value_col)
