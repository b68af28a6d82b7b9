"""Small Column builders shared by all operators (all native, codegen friendly)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def np_round(c, digits: int) -> Column:
    """Half-even rounding of ``c * 10**d`` like numpy's ``round`` (multiply, rint, divide)."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def map_lookup(c, mapping: dict, default=None) -> Column:
    """Literal dictionary lookup with a default for unknown and NULL keys."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    looked = F.try_element_at(m, col(c))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def first_match(rules, default) -> Column:
    """CASE WHEN cond1 THEN v1 WHEN cond2 THEN v2 ... ELSE default (first rule wins)."""
    expr = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if expr is None else expr.otherwise(d)


def contains_any(c, needles) -> Column:
    """OR of literal substring tests (no regex)."""
    out = None
    for n in needles:
        t = F.contains(col(c), F.lit(n))
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int with NULL treated as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_div(a, b) -> Column:
    return F.try_divide(col(a), col(b))
