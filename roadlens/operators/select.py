"""Feature scoring and selection (SEL-01..04, 07..12) in closed form.

All per-feature statistics come from a few aggregates over the wide feature matrix (class
statistics, counts between quantile brackets, cross products); the outputs are
feature-sized tables (tens to hundreds of rows) ranked with windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.common import np_round
from roadlens.session import ensure_checkpoint_dir


def class_stats(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per class and feature: y, n (rows), feature, c (values), m, v (sample variance), lo, hi.  One
    aggregate over the wide rows (a row per class), unpivoted afterwards."""
    x = {f: F.col(f).cast("double") for f in features}
    wide = df.groupBy(F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.struct(F.count(x[f]).alias("c"), F.avg(x[f]).alias("m"), F.var_samp(x[f]).alias("v"),
                                                 F.min(x[f]).alias("lo"), F.max(x[f]).alias("hi")).alias(f"s_{f}") for f in features])
    each = wide.select("y", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("s")) for f in features])).alias("e"))
    return each.select("y", "n", "e.feature", "e.s.*")


def _finite(c):
    return F.when(F.col(c).isNull() | F.isnan(F.col(c)), F.lit(0.0)).otherwise(F.col(c))


def point_biserial(stats: DataFrame) -> DataFrame:
    """SEL-01: |corr(x, y)| per feature from its class statistics; constant feature -> 0."""
    per = Window.partitionBy("feature")
    w = stats.withColumn("c", F.when(F.col("y").isNotNull(), F.col("c")).otherwise(F.lit(0)))
    total = F.sum("c").over(per)
    j = w.select("feature", "c", "m", "v", "y", "lo", "hi", F.when(total > 0, F.sum(F.col("c") * F.col("m")).over(per) / total).alias("mx"),
                 F.when(total > 0, F.sum(F.col("c") * F.col("y")).over(per) / total).alias("my")).where("c > 0")
    dx, dy = F.col("m") - F.col("mx"), F.col("y") - F.col("my")
    g = j.groupBy("feature").agg(F.sum(F.col("c") * dx * dy).alias("xy"), F.sum((F.col("c") - 1) * F.coalesce("v", F.lit(0.0)) + F.col("c") * dx * dx).alias("xx"),
                                 F.sum(F.col("c") * dy * dy).alias("yy"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    g = g.withColumn("r", F.when((F.col("lo") < F.col("hi")) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")))
    return stats.select("feature").distinct().join(g.select("feature", "r"), "feature", "left").select("feature", F.abs(_finite("r")).alias("abs_corr"))


def anova_f(stats: DataFrame) -> DataFrame:
    """SEL-04: one-way ANOVA F from per-class n, mean, sample variance (numerically stable centred form);
    non-finite -> 0."""
    per = Window.partitionBy("feature")
    j = stats.select("feature", "n", "m", "v", F.sum("n").over(per).alias("n_total"), F.count("y").over(per).alias("k"),
                     (F.sum(F.col("c") * F.col("m")).over(per) / F.sum("c").over(per)).alias("grand_mean"))
    s = j.groupBy("feature", "n_total", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand_mean"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n_total") - F.col("k")))
    return s.select("feature", F.when((F.col("ssw") == 0) | (F.col("k") < 2), F.lit(0.0)).otherwise(f).alias("f_score"))


def chi2(stats: DataFrame) -> DataFrame:
    """SEL-03: chi-square of min-max-scaled x against the class: observed = per-class sum
    of scaled x, expected = class share x total scaled sum."""
    tot = Window.partitionBy("feature")
    j = stats.select("feature", "n", "c", "m", F.min("lo").over(tot).alias("lo"), F.max("hi").over(tot).alias("hi"), F.sum("n").over(tot).alias("n_total"))
    obs = j.withColumn("o", F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(F.col("c") * (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    e = obs.select("feature", "o", (F.col("n") / F.col("n_total") * F.sum("o").over(tot)).alias("e"))
    return e.groupBy("feature").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))
                                          .otherwise(F.lit(0.0))).alias("chi2"))


ACCURACY = 5_000       # of the sketch that brackets the quantiles (shapes the work, not the result)


def _brackets(df: DataFrame, features: list[str], probs: list[float], accuracy: int) -> dict[str, tuple]:
    """feature -> (values that are numbers, brackets (L, H) of each p) from one sketch pass; features without values are left out."""
    eps = 3.0 / accuracy
    probes = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    value = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    got = df.agg(*[F.struct(F.count(value[f]).alias("n"), F.percentile_approx(value[f], probes, accuracy).alias("q")).alias(f"s{i}")
                   for i, f in enumerate(features)]).first()
    out = {}
    for i, f in enumerate(features):
        if got[i]["n"]:
            q = dict(zip(probes, got[i]["q"], strict=True))
            out[f] = (got[i]["n"], [(q[max(0.0, p - eps)], q[min(1.0, p + eps)]) for p in probs])
    return out


def _cells(df: DataFrame, label: str, edges: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """feature, slot, exact, x, y, n: the rows of each class at every edge (odd slots), at every distinct value of the
    opened intervals between edges (exact), and in each closed interval as a whole (x: its lower edge)."""
    names = list(edges)
    cols = ["feature", "slot", "exact", "x", "y", "n"]

    def rows(f, slot, exact, x, y, n):
        y = pa.array(np.nan_to_num(y).astype(np.int32), pa.int32(), mask=np.isnan(y))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), f, np.int32)), pa.array(slot.astype(np.int32)), pa.array(exact), pa.array(x),
                                           y, pa.array(n.astype(np.int64))], names=cols)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            y = b.column(len(names)).cast(pa.float64()).to_numpy(zero_copy_only=False)          # null: NaN
            classes, cls = np.unique(y, return_inverse=True)
            for f, name in enumerate(names):
                e, opened = edges[name]
                there = b.column(f).is_valid().to_numpy(zero_copy_only=False)
                x = b.column(f).drop_null().to_numpy(zero_copy_only=False)
                slot, many = np.searchsorted(e, x, "left") + np.searchsorted(e, x, "right"), 2 * len(e) + 1
                mine = cls[there]
                inside = opened[slot]
                if inside.any():
                    yield rows(f, slot[inside], np.ones(inside.sum(), bool), x[inside], classes[mine[inside]], np.ones(inside.sum()))
                count = np.bincount(mine[~inside] * many + slot[~inside], minlength=len(classes) * many)
                for k, c in enumerate(classes):
                    key = (f, None if np.isnan(c) else float(c))
                    totals[key] = totals.get(key, 0) + count[k * many:(k + 1) * many]
        for (f, c), count in totals.items():
            e = edges[names[f]][0]
            slot = np.flatnonzero(count)
            odd = slot % 2 == 1
            x = np.r_[-np.inf, e][np.where(odd, (slot + 1) // 2, slot // 2)]
            if len(slot):
                yield rows(f, slot, odd, x, np.full(len(slot), np.nan if c is None else c), count[slot])

    wide = df.select(*[F.col(f).cast("double").alias(f) for f in names], F.col(label).cast("int").alias("y"))
    each = wide.mapInArrow(counted, "feature int, slot int, exact boolean, x double, y int, n long")
    return each.groupBy("feature", "slot", "exact", "x", "y").agg(F.sum("n").alias("n")).checkpoint(eager=True)


def quantile_mutual_info(df: DataFrame, features: list[str], label: str, bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """SEL-02: mutual information (nats) of quantile bins of x with y.  The cut points are each feature's
    exact quantiles k / ``bins``; a value's bin is the number of cut points below it, so equal values
    share a bin and a feature of few values keeps them apart.

    Two passes over the wide rows: a sketch brackets each quantile, then rows are counted by class at and
    between the brackets' ends, where only the values inside a bracket are kept apart.  Both the exact
    quantiles and the bins' counts are read off that table; its counts prove that each bracket holds its
    quantile (else the feature's values are all kept apart)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    probs = [k / bins for k in range(1, bins)]
    found = _brackets(df, features, probs, accuracy or ACCURACY)
    if not found:
        return spark.createDataFrame([], "feature string, mutual_info double")
    edges = {}
    for f, (_, lohi) in found.items():
        e = np.unique(np.array(lohi, np.float64))
        opened = np.zeros(2 * len(e) + 1, bool)
        for lo, hi in lohi:
            opened[2 * np.searchsorted(e, lo) + 2:2 * np.searchsorted(e, hi) + 1:2] = True
        edges[f] = (e, opened)
    cells = _cells(df, label, edges)
    cuts, missed = _cuts(cells, edges, found, probs)
    if missed:
        whole = {f: (np.array([np.inf]), np.array([True, False, False])) for f in missed}
        again = _cells(df, label, whole)
        more, left = _cuts(again, whole, found, probs)
        cuts |= more
        if left:
            raise ValueError(f"no quantiles of {left}")
        names = list(edges)
        cells = (cells.where(~F.col("feature").isin([names.index(f) for f in missed]))
                 .unionByName(again.withColumn("feature", F.element_at(F.array(*[F.lit(names.index(f)) for f in whole]), F.col("feature") + 1))))
    table = spark.createDataFrame([(i, f, cuts[f]) for i, f in enumerate(edges)], "feature int, name string, cuts array<double>")
    below = F.size(F.filter("cuts", lambda c: (c < F.col("x")) | (~F.col("exact") & (c == F.col("x")))))
    c = cells.join(F.broadcast(table), "feature").groupBy(F.col("name").alias("feature"), below.alias("bin"), "y").agg(F.sum("n").alias("nxy"))
    total = F.sum("nxy").over(Window.partitionBy("feature"))
    t = c.select("feature", (F.col("nxy") / total).alias("pxy"), (F.sum("nxy").over(Window.partitionBy("feature", "bin")) / total).alias("px"),
                 (F.sum("nxy").over(Window.partitionBy("feature", "y")) / total).alias("py"))
    return t.groupBy("feature").agg(F.sum(F.col("pxy") * F.log(F.col("pxy") / (F.col("px") * F.col("py")))).alias("mutual_info"))


def _cuts(cells: DataFrame, edges: dict[str, tuple], found: dict[str, tuple], probs: list[float]) -> tuple[dict[str, list[float]], list[str]]:
    """The exact quantiles (linear between ranks) of each feature, and the features whose brackets miss one."""
    spark, names = cells.sparkSession, list(edges)
    counts = {f: np.zeros(2 * len(e) + 1, np.int64) for f, (e, _) in edges.items()}
    for r in cells.groupBy("feature", "slot").agg(F.sum("n").alias("n")).collect():              # features x slots
        counts[names[r["feature"]]][r["slot"]] = r["n"]
    wanted, value, missed = {}, {}, []
    for i, f in enumerate(names):
        before = np.r_[0, np.cumsum(counts[f])]
        for p in probs:
            k = p * (found[f][0] - 1)
            for rank in {math.floor(k), math.ceil(k)}:
                slot = int(np.searchsorted(before, rank, "right")) - 1
                if slot % 2:
                    value[f, rank] = float(edges[f][0][slot // 2])
                elif edges[f][1][slot]:
                    wanted[i, slot, rank - int(before[slot])] = (f, rank)
                elif f not in missed:
                    missed.append(f)
    if wanted:
        at = spark.createDataFrame(list(wanted), "feature int, slot int, off long")
        inner = cells.where("exact and slot % 2 = 0").groupBy("feature", "slot", "x").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("feature", "slot").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        hit = inner.withColumn("upto", upto).join(F.broadcast(at), ["feature", "slot"]).where("off >= upto - n and off < upto")
        for r in hit.collect():                                                                 # two ranks a quantile
            value[wanted[r["feature"], r["slot"], r["off"]]] = r["x"]
    out = {}
    for f in names:
        if f not in missed:
            out[f] = []
            for p in probs:
                k = p * (found[f][0] - 1)
                lo, hi = value[f, math.floor(k)], value[f, math.ceil(k)]
                out[f].append(lo + (hi - lo) * (k - math.floor(k)))
    return out, missed


def score_table(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Four closed-form scores per feature joined into one table."""
    ensure_checkpoint_dir(df.sparkSession)
    stats = class_stats(df, features, label).checkpoint(eager=True)        # features x classes, read by three scores
    return (point_biserial(stats).join(quantile_mutual_info(df, features, label), "feature")
            .join(chi2(stats), "feature").join(anova_f(stats), "feature"))


METHODS = ["abs_corr", "mutual_info", "chi2", "f_score"]


def consensus(scores: DataFrame, methods: list[str] = METHODS, categories=None) -> DataFrame:
    """SEL-08: min-rank per method (higher score = rank 1), mean rank to 3 decimals, its min-rank as
    ensemble rank, category.  One row per feature."""
    from roadlens.functions.text import name_category
    rk = [F.rank().over(Window.orderBy(F.col(m).desc())).alias(f"rank_{m}") for m in methods]
    r = scores.select("feature", *methods, *rk)
    mean = sum((F.col(f"rank_{m}") for m in methods), F.lit(0)) / F.lit(float(len(methods)))
    r = r.withColumn("mean_rank", np_round(mean, 3))
    r = r.withColumn("ensemble_rank", F.rank().over(Window.orderBy("mean_rank")))
    if categories:
        r = r.withColumn("category", name_category("feature", categories))
    return r


def top_subsets(ranked: DataFrame, ks=(10, 20, 30)) -> DataFrame:
    """SEL-09: the k best features by ensemble rank (equal ranks by name)."""
    placed = ranked.select("feature", "ensemble_rank", F.row_number().over(Window.orderBy("ensemble_rank", "feature")).alias("place"))
    k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return placed.select(k, "feature", "ensemble_rank", "place").filter(F.col("place") <= F.col("k")).drop("place")


def category_summary(ranked: DataFrame) -> DataFrame:
    """SEL-10: per category n, n in the top 10 and 30, best rank, mean scores."""
    return ranked.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("ensemble_rank") <= 10).alias("n_top10"),
        F.count_if(F.col("ensemble_rank") <= 30).alias("n_top30"), F.min("ensemble_rank").alias("best_rank"),
        F.avg("abs_corr").alias("mean_abs_corr"), F.avg("mutual_info").alias("mean_mi"), F.avg("f_score").alias("mean_f"))


def agreement(ranked: DataFrame, methods: list[str] = METHODS, top: int = 10) -> DataFrame:
    """SEL-11: number of methods placing each feature in their top-n."""
    votes = sum(((F.col(f"rank_{m}") <= top).cast("int") for m in methods), F.lit(0))
    return ranked.select("feature", votes.alias("votes"))


PAIRS_PER_PASS = 300   # pairs whose sums go out together (a limit of a batch, not of the answer)


def redundant_pairs(df: DataFrame, features: list[str], threshold: float = 0.90, drop_at: float = 0.95) -> DataFrame:
    """SEL-07: pairs (upper triangle) with |r| >= threshold; advice 'drop' at >= drop_at.

    Every pair is correlated over the rows where both are present, at any number of features: each task
    sums cross products about the features' means (matrix products), a row per pair, which are added up."""
    m = len(features)
    a, b = np.triu_indices(m, 1)
    if not len(a):
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, abs_corr double, advice string")
    data = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    mean = data.agg(*[F.avg(c) for c in features]).first()
    centre = np.array([0.0 if v is None or not math.isfinite(v) else v for v in mean])
    step, names = PAIRS_PER_PASS, ["a", "b", "n", "sx", "sy", "xx", "yy", "xy"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.float64)
            x = np.stack([c.fill_null(v).to_numpy(zero_copy_only=False) for c, v in zip(batch.columns, centre, strict=True)], 1) - centre
            n, s, q, xy = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
            part = np.stack([n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], xy[a, b]], 1)
            total = part if total is None else total + part
        if total is not None:
            for lo in range(0, len(a), step):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo:lo + step].astype(np.int32)), pa.array(b[lo:lo + step].astype(np.int32)),
                                                  *[pa.array(np.ascontiguousarray(total[lo:lo + step, k])) for k in range(6)]], names=names)

    each = data.mapInArrow(summed, "a int, b int, n double, sx double, sy double, xx double, yy double, xy double")
    g = each.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names[2:]]).where("n > 0")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    # what rounding leaves of a constant is no variance
    r = F.when((vx > 1e-11 * F.col("xx")) & (vy > 1e-11 * F.col("yy")), (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx) / F.sqrt(vy))
    name = lambda c: F.element_at(F.array(*map(F.lit, features)), F.col(c) + 1)
    long = g.select(name("a").alias("feature_a"), name("b").alias("feature_b"), r.alias("r"))
    every = df.sparkSession.createDataFrame([(features[i], features[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], "feature_a string, feature_b string")
    return (every.join(long, ["feature_a", "feature_b"], "left").select("feature_a", "feature_b", F.abs(_finite("r")).alias("abs_corr"))
            .filter(F.col("abs_corr") >= threshold)
            .withColumn("advice", F.when(F.col("abs_corr") >= drop_at, "drop one").otherwise("review")))


def drop_candidates(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """SEL-12: the lower-ranked feature of each redundant pair (double join to ranks)."""
    ra = ranked.select(F.col("feature").alias("feature_a"), F.col("ensemble_rank").alias("ra"))
    rb = ranked.select(F.col("feature").alias("feature_b"), F.col("ensemble_rank").alias("rb"))
    j = pairs.join(ra, "feature_a").join(rb, "feature_b")
    return j.select(F.when(F.col("ra") > F.col("rb"), F.col("feature_a")).otherwise(F.col("feature_b"))
                    .alias("feature")).distinct()
