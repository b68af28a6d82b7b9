"""Plan checks: native operators stay JVM-side, scans are pruned, fits
do not put event-sized data through one task."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

QUERIES = E.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = ["cln_03", "cln_04", "txt_01", "txt_02", "txt_06", "txt_08", "txt_11", "dtm_01", "dtm_10", "geo_02",
          "geo_03", "geo_04", "geo_05", "geo_11", "evt_01", "evt_06", "scr_04", "scr_19", "agg_07", "agg_05"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_have_no_python(spark, name):
    p = plan_of(QUERIES[name](spark, SF0001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def _read_schemas(p: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", p)


def test_incident_projection_is_pruned_to_used_columns(spark):
    # cln_04 only needs event_id and ts out of events(event_id, ts, user_id, event_type, value, props)
    p = plan_of(QUERIES["cln_04"](spark, SF0001))
    cols = {c.split(":")[0] for s in _read_schemas(p) for c in s.split(",")}
    assert cols == {"event_id", "ts"}, cols


def test_text_scan_reads_two_columns(spark):
    p = plan_of(QUERIES["txt_01"](spark, SF0001))
    cols = {c.split(":")[0] for s in _read_schemas(p) for c in s.split(",")}
    assert cols == {"doc_id", "text"}, cols


def test_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F
    from roadlens.sources.tables import read_table
    df = read_table(spark, SF0001, "lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey")
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p


def test_flagship_lookups_are_not_shuffle_joins(spark):
    p = plan_of(E.entry(spark))
    assert "SortMergeJoin" not in p


def test_no_unpartitioned_window_on_events(spark):
    """Rolling counts, queue positions and splits never gather event rows in one task:
    the only single-partition exchange allowed is the per-partition offset table
    (an aggregate keyed by the partition id: #partitions x #groups rows)."""
    for name in ("rol_01", "srt_01", "spl_01"):
        lines = plan_of(QUERIES[name](spark, SF0001)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate(keys=[__pid" in lines[i + 1], (name, lines[i + 1])
