"""Rolling and calendar-window counts (ROL-01..04).

ROL-01/02 are half-open range joins "count training events in [ts - w, ts)".
The reference loops over rows (quadratic).  Here the count is a difference of two
prefix sums over one global order of training instants and probe points, computed
with balanced range partitions (skew-proof, exact, linear in rows plus one sort).
ROL-03/04 are equi-joins to per-day counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators import rates

HOUR_US = 3600 * 1_000_000


def window_counts(df: DataFrame, train: DataFrame, hours, ts: str = "ts", key: str = "id",
                  by: list[str] = (), out=None) -> DataFrame:
    """Per row of ``df`` (unique ``key``): number of ``train`` rows with time in
    [ts - w, ts) (same ``by`` keys), for one width or several (``hours`` int or list).

    count = C(ts) - C(ts - w) with C(x) = number of training instants strictly before
    x.  Training instants (pre-aggregated per distinct microsecond) and probe points
    (ts and ts - w per row and width) are ordered by (by, time, probe-first) and C is
    the exclusive weighted prefix sum at each probe (``prefix.weighted_prefix``):
    range partitioning splits any burst or hot key across tasks, so no bucket or
    group ever lands whole in one task.  Rows without a timestamp or with a NULL
    ``by`` key count 0."""
    from roadlens.operators.prefix import weighted_prefix
    by = list(by)
    hours_l = list(hours) if isinstance(hours, (list, tuple)) else [hours]
    outs = (list(out) if isinstance(out, (list, tuple)) else [out]) if out else \
        [f"rolling_{h}h_system_count" for h in hours_l]
    us = F.unix_micros(F.col(ts))
    keys_ok = F.lit(True)
    for b in by:
        keys_ok = keys_ok & F.col(b).isNotNull()
    tr = (train.filter(F.col(ts).isNotNull() & keys_ok).select(*by, us.alias("__t"))
          .groupBy(*by, "__t").agg(F.count(F.lit(1)).cast("double").alias("__w"))
          .select(*by, "__t", F.lit(1).alias("__kind"), "__w", F.lit(None).cast("long").alias("__id"),
                  F.lit(None).cast("int").alias("__probe")))
    live = df.filter(F.col(ts).isNotNull() & keys_ok)
    probe_arr = F.array(F.struct(F.lit(-1).alias("p"), us.alias("t")),
                        *[F.struct(F.lit(i).alias("p"), (us - F.lit(h * HOUR_US)).alias("t"))
                          for i, h in enumerate(hours_l)])
    probes = (live.select(*by, F.col(key).cast("long").alias("__id"), F.explode(probe_arr).alias("__pr"))
              .select(*by, F.col("__pr.t").alias("__t"), F.lit(0).alias("__kind"), F.lit(0.0).alias("__w"), "__id",
                      F.col("__pr.p").alias("__probe")))
    pref = weighted_prefix(probes.unionByName(tr), ["__t", "__kind"], by, "__w", "__pre")
    hi = F.sum(F.when(F.col("__probe") == -1, F.col("__pre")))
    counts = (pref.filter(F.col("__kind") == 0).groupBy("__id")
              .agg(*[(hi - F.sum(F.when(F.col("__probe") == i, F.col("__pre")))).cast("long").alias(o)
                     for i, o in enumerate(outs)]))
    res = df.join(counts, df[key] == counts["__id"], "left")
    return res.select(*df.columns, *[F.coalesce(F.col(o), F.lit(0)).cast("long").alias(o) for o in outs])


def same_day_counts(df: DataFrame, train: DataFrame, ts: str = "ts", by: list[str] = (),
                    out: str = "events_same_day") -> DataFrame:
    """ROL-03/04: training events on the same UTC date (and same ``by`` keys); NULL -> 0."""
    by = list(by)
    t = (train.filter(F.col(ts).isNotNull()).select(*by, F.to_date(F.col(ts)).alias("__d"))
         .groupBy(*by, "__d").agg(F.count(F.lit(1)).alias("__n")))
    tmp = df.withColumn("__d", F.to_date(F.col(ts)))
    res = rates.lookup(tmp, t, [*by, "__d"], {"__n": 0})
    return res.select(*df.columns, F.col("__n").cast("long").alias(out))
