"""Fit-aggregate / lookup-join primitives.

*fit*: ``groupBy(keys).agg(count, avg)`` over the training rows -> a statistics
table with one row per key.  Partial aggregation happens map-side, so a hot key
(a third of all rows) costs one partial row per task, never a skewed shuffle.

*transform*: left join of the fact rows to the statistics table + ``coalesce``
to the default.  The statistics side is broadcast only when its size is proven
small: either the caller asserts a fixed key domain (hour, hour bin, cause), or
the table is materialised and its row count checked against
``MAX_BROADCAST_ROWS``; beyond that the join is a plain shuffle join and AQE
picks the strategy.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.common import col

MAX_BROADCAST_ROWS = 2_000_000
MAX_LOCAL_ROWS = 50_000


def checked_broadcast(table: DataFrame, bounded: bool = False,
                      max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Return ``table`` marked for broadcast only if it is provably small.

    ``bounded=True``: the caller knows the key domain is a fixed small set.
    Otherwise one job takes at most ``MAX_LOCAL_ROWS + 1`` rows of the (already
    aggregated) table: if it fits, those rows become a local relation that is
    broadcast (the aggregate is never recomputed); if not, the table is persisted,
    its exact size counted, and it is broadcast only under ``max_rows`` — beyond
    that it stays a shuffle join sized by AQE.
    """
    if bounded:
        return F.broadcast(table)
    rows = table.take(MAX_LOCAL_ROWS + 1)
    if len(rows) <= MAX_LOCAL_ROWS:
        return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    n = table.count()
    return F.broadcast(table) if n <= max_rows else table


def global_mean(df: DataFrame, target: str) -> float:
    """Prior = mean of the target over all training rows (a one-row aggregate)."""
    v = df.agg(F.avg(F.col(target).cast("double")).alias("m")).first()["m"]
    return float(v) if v is not None else 0.0


def group_counts(df: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Count (and target mean) per non-NULL key combination (pandas drops NULL keys)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    aggs = [F.count(F.lit(1)).alias("n")]
    if target is not None:
        aggs.append(F.avg(F.col(target).cast("double")).alias("mean"))
    return df.filter(cond).groupBy(*keys).agg(*aggs)


def smoothed_rate_table(train: DataFrame, keys: list[str], target: str, alpha: float,
                        prior: float, min_count: int = 0, out: str = "rate") -> DataFrame:
    """``(n*mean + alpha*prior)/(n + alpha)``; groups with ``n < min_count`` get ``prior``."""
    st = group_counts(train, keys, target)
    sm = (F.col("n") * F.col("mean") + F.lit(alpha * prior)) / (F.col("n") + F.lit(float(alpha)))
    if min_count:
        sm = F.when(F.col("n") < min_count, F.lit(prior)).otherwise(sm)
    return st.select(*keys, sm.alias(out), F.col("n").alias(f"{out}_n"))


def share_table(train: DataFrame, keys: list[str], out: str = "share", total: int | Column | None = None,
                drop_null_keys: bool = True) -> DataFrame:
    """Count per key / total rows (``total`` defaults to all training rows, NULL keys included)."""
    st = group_counts(train, keys) if drop_null_keys else train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if total is None:
        tot = train.agg(F.count(F.lit(1)).alias("_tot"))
        return st.crossJoin(F.broadcast(tot)).select(
            *keys, (F.col("n") / F.col("_tot")).alias(out), F.col("n").alias(f"{out}_n"))
    return st.select(*keys, (F.col("n") / (total if isinstance(total, Column) else F.lit(total))).alias(out),
                     F.col("n").alias(f"{out}_n"))


def lookup(df: DataFrame, table: DataFrame, on: list[str] | dict, defaults: dict,
           bounded: bool = False) -> DataFrame:
    """Left-join ``table`` to ``df`` on keys and fill misses with ``defaults``.

    ``on`` is a list of shared key names or a dict ``{df_column: table_column}``.
    Only the columns named in ``defaults`` are brought over.
    """
    if isinstance(on, dict):
        pairs = list(on.items())
    else:
        pairs = [(k, k) for k in on]
    ren = {tk: f"__k{i}" for i, (_, tk) in enumerate(pairs)}
    t = table.select(*[F.col(tk).alias(ren[tk]) for _, tk in pairs],
                     *[F.col(c).alias(f"__v_{c}") for c in defaults])
    t = checked_broadcast(t, bounded=bounded)
    cond = None
    for dk, tk in pairs:
        c = col(dk) == F.col(ren[tk])
        cond = c if cond is None else cond & c
    joined = df.join(t, cond, "left")
    keep = [c for c in df.columns]
    fills = [F.coalesce(F.col(f"__v_{c}"), F.lit(d)).alias(c) if d is not None else F.col(f"__v_{c}").alias(c)
             for c, d in defaults.items()]
    return joined.select(*[F.col(c) for c in keep if c not in defaults], *fills)
