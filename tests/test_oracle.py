"""Every query with an oracle must match DuckDB at sf0.001 (row count, columns, values)."""

from __future__ import annotations

import datetime as dt
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _canon(sdf.columns, srows) == _canon(rel.columns, rel.fetchall())


def test_every_query_has_a_builder():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[0] == "zone" and len(rows) > 0
