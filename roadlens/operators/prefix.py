"""P1: exact global positions / quantiles without a single-partition window.

``global_positions`` range-partitions by (group, order, tiebreak), sorts inside
each partition, numbers rows with ``monotonically_increasing_id`` (partition
index in the high bits, in-partition ordinal in the low bits), and adds a
per-(partition, group) offset computed from a tiny count table
(#partitions x #groups rows, broadcast).  The numbered rows are checkpointed
once, so counts and rows come from the same materialisation.  A unique tiebreak is
added before the shuffle so that a hot value (say a third of all rows) is split
across partitions instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.operators.unpivot import melt


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_positions(df: DataFrame, order_cols: list, group_cols: list[str] = (), out: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``group_cols``).

    The range-sorted rows are numbered once and cut with a reliable ``checkpoint()``
    (shared folder named by ``spark.checkpoint.dir``); counts and positions are both
    read from that single materialisation, so they agree even if adaptive re-planning
    or a lost executor would recompute the upstream plan differently.
    """
    from roadlens.session import ensure_checkpoint_dir
    group_cols = list(group_cols)
    n = _num_partitions(df, num_partitions)
    tagged = df.withColumn("__tb", F.monotonically_increasing_id())
    keys = [*group_cols, *order_cols, "__tb"]
    ensure_checkpoint_dir(df.sparkSession)
    numbered = (tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    stats = numbered.groupBy("__pid", *group_cols).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    before = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("__pid", *group_cols, "__m0",
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    joined = numbered.join(F.broadcast(stats), ["__pid", *group_cols], "inner")
    return joined.select(*df.columns, (F.col("__off") + F.col("__mid") - F.col("__m0")).alias(out))


def _quantiles_by_sort(long: DataFrame, probs: list[float], num_partitions: int | None = None) -> DataFrame:
    """Exact quantiles by ordering every value (P1 over the whole long table)."""
    pos = global_positions(long, ["value"], ["column"], num_partitions=num_partitions)
    counts = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    spark = long.sparkSession
    ps = spark.createDataFrame([(float(p),) for p in probs], "p double")
    tg = counts.crossJoin(ps).select(F.col("column").alias("__c"), "p", (F.col("p") * (F.col("n") - 1)).alias("k"))
    tg = tg.select("__c", "p", "k", F.floor("k").cast("long").alias("lo"), F.ceil("k").cast("long").alias("hi"))
    picked = pos.join(F.broadcast(tg), (F.col("column") == F.col("__c"))
                      & ((F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi"))))
    agg = picked.groupBy("__c", "p", "k", "lo").agg(
        F.max(F.when(F.col("pos") == F.col("lo"), F.col("value"))).alias("vlo"),
        F.max(F.when(F.col("pos") == F.col("hi"), F.col("value"))).alias("vhi"))
    return agg.select(F.col("__c").alias("column"), "p",
                      (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("k") - F.col("lo"))).alias("value"))


MAX_LOCAL_INTERIOR = 50_000


def _interior_by_positions(spark, inner: DataFrame, good: list, c: dict, num_partitions) -> DataFrame:
    """Large interiors: exact positions by P1, target ranks read off in Spark."""
    pos = global_positions(inner, ["value"], ["bcol", "j"], num_partitions=num_partitions)
    rows = []
    for b in good:
        r = c[(b[0], b[2])]
        rows.append((b[0], b[2], b[1], b[3], b[4], b[5], b[6], b[7], r["c_lt"], r["c_eqL"], r["c_in"]))
    meta = spark.createDataFrame(rows, "mcol string, mj int, p double, lo long, hi long, k double, L double, "
                                       "H double, c_lt long, c_eqL long, c_in long")

    def at(rank):
        base = F.col("c_lt") + F.col("c_eqL")
        return (F.when(rank < base, F.col("L")).when(rank < base + F.col("c_in"), F.lit(None))
                .otherwise(F.col("H")), rank - base)
    lo_direct, lo_off = at(F.col("lo"))
    hi_direct, hi_off = at(F.col("hi"))
    m2 = meta.select("*", lo_direct.alias("vlo_d"), lo_off.alias("lo_off"), hi_direct.alias("vhi_d"),
                     hi_off.alias("hi_off"))
    need = pos.join(F.broadcast(m2.select("mcol", "mj", "lo_off", "hi_off")),
                    (F.col("bcol") == F.col("mcol")) & (F.col("j") == F.col("mj"))
                    & ((F.col("pos") == F.col("lo_off")) | (F.col("pos") == F.col("hi_off"))))
    vals = need.groupBy("mcol", "mj").agg(
        F.max(F.when(F.col("pos") == F.col("lo_off"), F.col("value"))).alias("vlo_s"),
        F.max(F.when(F.col("pos") == F.col("hi_off"), F.col("value"))).alias("vhi_s"))
    res = m2.join(vals, ["mcol", "mj"], "left")
    vlo = F.coalesce("vlo_d", "vlo_s")
    vhi = F.coalesce("vhi_d", "vhi_s")
    return res.select(F.col("mcol").alias("column"), "p",
                      (vlo + (vhi - vlo) * (F.col("k") - F.col("lo"))).alias("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    num_partitions: int | None = None, accuracy: int = 100_000) -> DataFrame:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``) of many columns.

    Exact, without sorting all values:
      1. one pass: n per column and GK sketch values (``percentile_approx``, rank error
         <= n/accuracy) at p -/+ 3/accuracy -> a bracket [L, H] around the target ranks;
      2. one pass: exact counts below L, equal to L and equal to H per bracket;
      3. only values strictly inside (L, H) (at most ~6n/accuracy of them, hot values
         cannot sit there) are ordered: locally when the counted interior is small
         (<= MAX_LOCAL_INTERIOR), else with exact positions (P1); target ranks are read off.
    If the counts show a bracket missed its ranks, that column falls back to ordering
    all of its values (``_quantiles_by_sort``), so the result is always exact.
    Output: column, p, value."""
    spark = df.sparkSession
    long = melt(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, "column", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    eps = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    sk = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"),
                                    F.percentile_approx("value", probes, accuracy).alias("q")).collect()
    brackets = []   # (column, p, j, lo_rank, hi_rank, k, L, H)
    for r in sk:
        qmap = dict(zip(probes, r["q"]))
        for j, p in enumerate(probs):
            k = p * (r["n"] - 1)
            L = qmap[min(1.0, max(0.0, p - eps))]
            H = qmap[min(1.0, max(0.0, p + eps))]
            brackets.append((r["column"], float(p), j, int(math.floor(k)), int(math.ceil(k)), float(k), float(L), float(H)))
    if not brackets:
        return spark.createDataFrame([], "column string, p double, value double")
    bt = spark.createDataFrame(brackets, "bcol string, p double, j int, lo long, hi long, k double, L double, H double")
    j = long.join(F.broadcast(bt), F.col("column") == F.col("bcol"))
    cnt = j.groupBy("bcol", "j").agg(F.count_if(F.col("value") < F.col("L")).alias("c_lt"),
                                     F.count_if(F.col("value") == F.col("L")).alias("c_eqL"),
                                     F.count_if((F.col("value") > F.col("L")) & (F.col("value") < F.col("H"))).alias("c_in"),
                                     F.count_if(F.col("value") == F.col("H")).alias("c_eqH")).collect()
    c = {(r["bcol"], r["j"]): r for r in cnt}
    bad_cols = set()
    for b in brackets:            # verify each bracket really holds its two target ranks
        r = c.get((b[0], b[2]))
        lo_ok = r is not None and r["c_lt"] <= b[3]
        hi_ok = r is not None and b[4] < r["c_lt"] + r["c_eqL"] + r["c_in"] + (r["c_eqH"] if b[7] != b[6] else 0)
        if not (lo_ok and hi_ok):
            bad_cols.add(b[0])
    good = [b for b in brackets if b[0] not in bad_cols]
    parts = []
    if good:
        inner = (j.filter((F.col("value") > F.col("L")) & (F.col("value") < F.col("H")))
                 .select(F.col("bcol"), F.col("j"), "value"))
        n_inner = sum(c[(b[0], b[2])]["c_in"] for b in good)
        if n_inner <= MAX_LOCAL_INTERIOR:
            # the counting pass proved the interior small: rank it locally
            vals: dict = {}
            for r in inner.collect():
                vals.setdefault((r["bcol"], r["j"]), []).append(r["value"])
            rows = []
            for b in good:
                r = c[(b[0], b[2])]
                inside = sorted(vals.get((b[0], b[2]), []))
                base = r["c_lt"] + r["c_eqL"]

                def at(rank):
                    if rank < base:
                        return b[6]
                    if rank < base + len(inside):
                        return inside[rank - base]
                    return b[7]
                vlo, vhi = at(b[3]), at(b[4])
                rows.append((b[0], b[1], vlo + (vhi - vlo) * (b[5] - b[3])))
            parts.append(spark.createDataFrame(rows, "column string, p double, value double"))
        else:
            parts.append(_interior_by_positions(spark, inner, good, c, num_partitions))
    if bad_cols:
        parts.append(_quantiles_by_sort(long.filter(F.col("column").isin(sorted(bad_cols))), probs, num_partitions))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def quantile_row(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True) -> dict:
    """{(column, p): value} for small outputs; exact via P1, else percentile_approx."""
    if exact:
        rows = exact_quantiles(df, columns, probs).collect()
        return {(r["column"], r["p"]): r["value"] for r in rows}
    aggs = [F.percentile_approx(F.col(c), list(probs), 100000).alias(c) for c in columns]
    row = df.agg(*aggs).first()
    return {(c, p): (row[c][i] if row[c] is not None else None) for c in columns for i, p in enumerate(probs)}


# ------------------------------------------------------------------ splits (SPL-01..03)

def chronological_split(df: DataFrame, ts: str, key: str, test_fraction: float = 0.2) -> DataFrame:
    """SPL-01: first ``int(n*(1-f))`` rows by time (NULL times last, ties by key) are train.

    Exact global position by P1; adds ``split`` ('train'/'test') and ``pos``."""
    n_total = df.count()
    n_train = int(n_total * (1 - test_fraction))
    tmp = df.withColumn("__null_last", F.col(ts).isNull().cast("int"))
    pos = global_positions(tmp, ["__null_last", ts, key])
    return pos.drop("__null_last").withColumn("split", F.when(F.col("pos") < n_train, "train").otherwise("test"))


def mix_key(key, seed: int = 42):
    """Deterministic shuffle key for integer ids: multiplicative hash mod 2^32.

    Pure integer arithmetic (no overflow for any BIGINT id), so every engine and every
    task retry computes the same order."""
    return ((F.col(key) % 4294967296) * 40503 + F.lit(seed * 7919)) % 4294967296


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SPL-02: shuffled stratified k-fold: within each label, order by a seeded hash of
    the key then the key, fold = position mod k (retries reproduce it)."""
    tmp = df.withColumn("__h", mix_key(key, seed))
    pos = global_positions(tmp, ["__h", key], [label], out="__pos")
    return pos.drop("__h").withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__pos")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SPL-03: seeded subsample of exactly ``n`` rows (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(mix_key(key, seed), F.col(key)).limit(n)


# ------------------------------------------------------------------ weighted prefix sums

def weighted_prefix(df: DataFrame, order_cols: list, group_cols: list[str] = (), weight: str = "w",
                    out: str = "prefix", num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sum of ``weight`` in ``order_cols`` order within ``group_cols``.

    Same shape as ``global_positions``: range partitioning with a unique tie-break
    (a hot group or a burst of equal keys is split across tasks), an in-partition
    running sum computed on Arrow batches (``mapInPandas``, carried across the
    batches of one partition), a reliable checkpoint, and a tiny per-(partition,
    group) offset table added back with a broadcast join."""
    import pandas as pd
    from pyspark.sql import types as T
    from roadlens.session import ensure_checkpoint_dir
    group_cols = list(group_cols)
    n = _num_partitions(df, num_partitions)
    tagged = df.withColumn("__tb", F.monotonically_increasing_id())
    keys = [*group_cols, *order_cols, "__tb"]
    rp = tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = T.StructType(rp.schema.fields + [T.StructField("__pid", T.IntegerType()),
                                              T.StructField("__local", T.DoubleType())])

    def running(batches):
        import numpy as np
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry: dict = {}          # group key -> weight already seen in this partition
        for pdf in batches:
            w = pdf[weight].astype("float64").fillna(0.0)
            if group_cols and len(pdf):
                codes = pdf.groupby(group_cols, sort=False, dropna=False).ngroup().to_numpy()
                _, first = np.unique(codes, return_index=True)      # one row per group of the batch
                uniq = [tuple(None if pd.isna(v) else v for v in row)
                        for row in pdf[group_cols].iloc[first].itertuples(index=False, name=None)]
            else:
                codes, uniq = np.zeros(len(pdf), dtype=int), [None]
            base = np.array([carry.get(u, 0.0) for u in uniq], dtype="float64")[codes] if len(pdf) else np.zeros(0)
            local = w.groupby(codes, sort=False).cumsum().to_numpy() - w.to_numpy() + base
            for code, total in w.groupby(codes, sort=False).sum().items():
                carry[uniq[code]] = carry.get(uniq[code], 0.0) + float(total)
            pdf["__pid"] = pid
            pdf["__local"] = local
            yield pdf

    ensure_checkpoint_dir(df.sparkSession)
    numbered = rp.mapInPandas(running, schema).checkpoint(eager=True)
    stats = numbered.groupBy("__pid", *group_cols).agg(F.sum(F.col(weight).cast("double")).alias("__tot"))
    before = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("__pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("__pid", *group_cols, F.coalesce(F.sum("__tot").over(before), F.lit(0.0)).alias("__off"))
    cond = F.col("__pid") == F.col("__spid")
    st = stats.select(F.col("__pid").alias("__spid"), *[F.col(g).alias(f"__sg_{g}") for g in group_cols], "__off")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__sg_{g}"))
    joined = numbered.join(F.broadcast(st), cond, "inner")
    return joined.select(*df.columns, (F.col("__off") + F.col("__local")).alias(out))
