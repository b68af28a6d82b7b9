"""Explainability and refinement (XPL-01..06, SEL-05/06, RFN-01..05).

* impurity importances come from the fitted Spark model (a feature-sized vector);
* linear Shapley values are exact and computed as columns: w_j * z_j (training mean 0);
* tree Shapley values are exact too (path weights, Gauss-Legendre points), read from tables (``shapley``);
* permutation importance permutes a column with a random cyclic shift: rows get
  exact positions in a seeded hash order (P1) and take the partner row's values at
  position (pos + 1) mod n via an equi-join — no collect, no sort of all data on
  one task; all (feature, repeat) variants are scored in one pass, their AUCs are grouped rank sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.common import np_round
from roadlens.operators.prefix import global_positions
from roadlens.session import ensure_checkpoint_dir

SHAP_ROWS, SHAP_BLOCK = 100_000, 4_096   # rows that share a tree's tables; rows of a block
AUC_ROWS, AUC_CELLS = 40_000, 256        # rows whose scores are put into blocks at once; ranges of scores


def impurity_importance(model, features: list[str], spark) -> DataFrame:
    """XPL-01 / SEL-05: feature importances of a tree ensemble, ranked."""
    return ranked_importance(model.featureImportances.toArray().tolist(), features, spark)


def forest_importance(nodes: DataFrame, weight: tuple[float, float], features: list[str]) -> DataFrame:
    """XPL-01 over a node table: per tree the weighted impurity that each feature's splits take away, as a
    share of the tree's; the mean of the shares over the trees, ranked."""
    w = F.lit(weight[0]) * F.col("n0") + F.lit(weight[1]) * F.col("n1")
    impure = F.when(w > 0, 2 * F.lit(weight[0]) * F.col("n0") * F.lit(weight[1]) * F.col("n1") / w).otherwise(0.0)
    each = nodes.select("tree", "node", "feature", impure.alias("i"))
    # a child hands its impurity to its parent; what the parent had more is the split's gain
    handed = each.where("node > 1").groupBy("tree", F.expr("node div 2").alias("node")).agg(F.sum("i").alias("below"))
    gain = each.where("feature >= 0").join(handed, ["tree", "node"]).groupBy("tree", "feature").agg(F.sum(F.col("i") - F.col("below")).alias("g"))
    whole = gain.groupBy("tree").agg(F.sum("g").alias("t"))
    n = nodes.select("tree").distinct().agg(F.count(F.lit(1)).alias("n"))
    mean = (gain.join(whole, "tree").where("t > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
            .crossJoin(n).select("feature", (F.col("s") / F.col("n")).alias("importance")))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    out = names.join(mean, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def ranked_importance(imp: list[float], features: list[str], spark) -> DataFrame:
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def linear_shap(pipeline_model, df: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    """XPL-02 (linear, exact): contribution_j = w_j * z_j on the standardised inputs, whose training
    mean is 0; sum_j contribution_j + intercept = logit.  Long form (key, feature, shap)."""
    scaler, lr = pipeline_model.stages[0], pipeline_model.stages[-1]
    w = lr.coefficients.toArray().tolist()
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    terms = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.lit(wj) * (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
                  if s else F.lit(0.0)).alias("shap"))
        for f, wj, m, s in zip(features, w, mean, std)])
    return df.select(key, F.explode(terms).alias("t")).select(key, "t.feature", "t.shap")


def mean_abs_shap(shap_long: DataFrame) -> DataFrame:
    """XPL-03: mean |SHAP| per feature, ranked."""
    g = shap_long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_shap").desc(), "feature")))


def pick_cases(pred: DataFrame, key: str = "id") -> DataFrame:
    """XPL-04: extreme TP / FN / TN / FP rows (highest prob for TP/FP, lowest for FN/TN)."""
    case = (F.when((F.col("label") == 1) & (F.col("pred") == 1), "TP").when((F.col("label") == 1), "FN")
            .when(F.col("pred") == 0, "TN").otherwise("FP"))
    t = pred.select(key, "score", case.alias("case"))
    hi = t.groupBy("case").agg(F.max(F.struct("score", F.col(key).alias("k"))).alias("hi"),
                               F.min(F.struct("score", F.col(key).alias("k"))).alias("lo"))
    pick = F.when(F.col("case").isin("TP", "FP"), F.col("hi")).otherwise(F.col("lo"))
    return hi.select("case", pick["k"].alias(key), pick["score"].alias("score"))


def additive_explanation(shap_long: DataFrame, base: float, key: str = "id", k: int = 5) -> DataFrame:
    """XPL-05: base + contributions and the top-k terms by |value| per row."""
    w = Window.partitionBy(key).orderBy(F.abs("shap").desc(), "feature")
    tot = Window.partitionBy(key)
    return (shap_long.select(key, "feature", "shap", F.row_number().over(w).alias("rank"),
                             (F.lit(base) + F.sum("shap").over(tot)).alias("predicted_logit"))
            .filter(F.col("rank") <= k))


def tree_shap(rows: DataFrame, nodes: DataFrame, weight: tuple[float, float], features: list[str], key: str = "id") -> DataFrame:
    """XPL-02 (trees, exact): Shapley values of the forest's probability, long form (key, feature, shap).

    A leaf is a product game over the features on its path: feature i is worth 1 (row passes all its
    splits) or 0 if known and z_i, the share of training weight that passes them, if not.  Its Shapley
    value is  v (o_i - z_i) * integral over t of prod_{j != i} (z_j (1 - t) + o_j t),  a polynomial that
    Gauss-Legendre points integrate exactly.  Sum over features + mean of the model = its output."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from roadlens.operators import forest as fo
    from roadlens.operators import shapley
    width, spark = len(features), rows.sparkSession
    model = spark.sparkContext.broadcast(fo.model_arrays(nodes))
    trees, n = list(model.value), rows.count()
    parts = max(1, -(-n // SHAP_ROWS))
    groups = max(1, min(len(trees), -(-4 * spark.sparkContext.defaultParallelism // parts)))
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for a in range(0, b.num_rows, SHAP_BLOCK):
                keys, x = (b.column(c).slice(a, SHAP_BLOCK) for c in range(2))
                x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.ListArray.from_arrays(
                    pa.array([0, len(keys)], pa.int32()), keys), pa.array([x.tobytes()])], names=["part", "seq", "keys", "x"])
                seq += 1

    def long(keys, phi):
        many = len(keys)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(many), width))), pa.array(features * many, pa.string()),
                                           pa.array((phi / max(len(trees), 1)).T.ravel())], names=[key, "feature", "shap"])

    def valued(batches):
        held = [(b, i) for b in batches for i in range(b.num_rows)]
        if not held:
            return
        x = [np.frombuffer(b.column("x")[i].as_py(), np.float32).reshape(-1, width) for b, i in held]
        g = held[0][0].column("g")[0].as_py()                              # one partition is one group of trees
        phi = shapley.shares([model.value[t] for t in trees[g::groups]], weight, np.concatenate(x))
        ends = np.cumsum([0, *map(len, x)])
        for (b, i), start, end in zip(held, ends, ends[1:], strict=False):
            if groups == 1:
                yield long(b.column("keys")[i].values, phi[:, start:end])
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("part", "seq", "g", "keys")), pa.array([phi[:, start:end].tobytes()])],
                                                 names=["part", "seq", "g", "keys", "phi"])

    def summed(batches):
        for b in batches:
            for i in range(b.num_rows):
                some = b.column("some")[i].values
                phi = sum(np.frombuffer(some.field("phi")[int(j)].as_py()).reshape(width, -1) for j in np.argsort(some.field("g").to_numpy()))
                yield long(some.field("keys")[0].values, phi)

    ensure_checkpoint_dir(spark)
    blocks = (rows.select(key, "x").repartition(parts).mapInArrow(pack, f"part int, seq int, keys array<{kind}>, x binary").checkpoint(eager=True))
    each = (blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("at", F.col("part") * groups + F.col("g"))
            .repartitionById(parts * groups, "at").select("part", "seq", "g", "keys", "x"))
    out = f"{key} {kind}, feature string, shap double"
    if groups == 1:
        return each.mapInArrow(valued, out)
    return (each.mapInArrow(valued, f"part int, seq int, g int, keys array<{kind}>, phi binary").groupBy("part", "seq")
            .agg(F.collect_list(F.struct("g", "keys", "phi")).alias("some")).select("some").mapInArrow(summed, out))


def forest_base(nodes: DataFrame, weight: tuple[float, float]) -> float:
    """The model's mean over its training weight: what SHAP values are added to."""
    w = F.lit(weight[0]) * F.col("n0") + F.lit(weight[1]) * F.col("n1")
    return float(nodes.where("node = 1").agg(F.avg(F.lit(weight[1]) * F.col("n1") / w)).first()[0] or 0.0)


class ForestPredictor:
    """x (rows, features) -> mean probability over the trees, for use inside tasks.  A leaf's probability is taken as a whole
    number of 2 ^ -52, so that a score does not depend on the order of its sum."""

    def __init__(self, nodes: DataFrame, weight: tuple[float, float]):
        from roadlens.operators import forest as fo
        self.weight, self.model = weight, nodes.sparkSession.sparkContext.broadcast(fo.model_arrays(nodes))

    def trees(self):
        """Per tree: feature, threshold, child by (node, side) (a leaf leads to itself), leaf's number, levels."""
        import numpy as np

        from roadlens.operators import trees as T
        for node, feature, threshold, n0, n1 in self.model.value.values():
            child = np.stack(T.links(node, feature), 1).ravel()
            levels = int(node[-1]).bit_length() - int(node[0]).bit_length()
            yield np.maximum(feature, 0).astype(np.int64), threshold, child, np.rint(T.share(n0, n1, self.weight) * (1 << 52)).astype(np.int64), levels

    def scores(self, total):
        return total / float(1 << 52) / max(len(self.model.value), 1)

    def __call__(self, x):
        import numpy as np
        total, flat, start = np.zeros(len(x), np.int64), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for feature, threshold, child, value, levels in self.trees():
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                at = child.take(2 * at + (flat.take(start + feature.take(at)) > threshold.take(at)))
            total += value.take(at)
        return self.scores(total)

    def changed(self, x, other):
        """(1 + features, rows): scores as they are and with each feature by itself taken from ``other``.

        Rows go down a tree once; a feature's value matters first where it takes the other side of a split on the row's path,
        so only from there a row goes down again."""
        import numpy as np
        n, width = x.shape
        both, start = np.concatenate([np.ascontiguousarray(x).ravel(), np.ascontiguousarray(other).ravel()]), np.arange(n) * width
        total, delta = np.zeros(n, np.int64), np.zeros(width * n, np.int64)
        rows, f, base, node = (np.empty(n * width, np.int64) for _ in range(4))     # what goes down again: at most once for a row and feature
        for feature, threshold, child, value, levels in self.trees():
            at, seen, many = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            for _ in range(levels):
                mine, cut = feature.take(at), threshold.take(at)
                here = start + mine
                side = both.take(here) > cut
                here += n * width
                turned = np.flatnonzero(side != (both.take(here) > cut))
                at += at
                if many:
                    below = node[:many]
                    asked = feature.take(below)
                    there = (asked == f[:many]) * np.int64(n * width)
                    there += asked
                    there += base[:many]
                    go = both.take(there) > threshold.take(below)
                    below += below
                    below += go
                    node[:many] = child.take(below)
                mine, old = mine.take(turned), seen.take(turned)
                bit = np.left_shift(1, mine)
                new = (old & bit) == 0                                     # a feature that turned before is followed from there
                seen[turned] = old | bit
                turned, mine = turned[new], mine[new]
                end = many + len(turned)
                rows[many:end], f[many:end], base[many:end] = turned, mine, turned * width
                node[many:end] = child.take(at.take(turned) + ~side.take(turned))
                many = end
                at = child.take(at + side)
            own = value.take(at)
            total += own
            delta[f[:many] * n + rows[:many]] += value.take(node[:many]) - own.take(rows[:many])
        return self.scores(np.concatenate([total, np.tile(total, width) + delta])).reshape(1 + width, n)


def forest_predictor(nodes: DataFrame, weight: tuple[float, float]) -> ForestPredictor:
    return ForestPredictor(nodes, weight)


def leaf_paths(node, feature, threshold, n0, n1, weight, width):
    """Per leaf: probability, and per feature the share z of the weight that its splits let pass and their interval (lo, hi]."""
    import numpy as np

    from roadlens.operators import trees as T
    cover = weight[0] * n0 + weight[1] * n1
    left, right = T.links(node, feature)
    k = len(node)
    z, lo, hi = np.ones((k, width)), np.full((k, width), -np.inf), np.full((k, width), np.inf)
    for p in range(k):                               # parents come before their children
        f = feature[p]
        if f >= 0:
            for c, side in ((left[p], 0), (right[p], 1)):
                z[c], lo[c], hi[c] = z[p], lo[p], hi[p]
                z[c, f] *= cover[c] / max(cover[p], 1e-300)
                if side:
                    lo[c, f] = max(lo[c, f], threshold[p])
                else:
                    hi[c, f] = min(hi[c, f], threshold[p])
    leaf = feature < 0
    return T.share(n0, n1, weight)[leaf], z[leaf], lo[leaf], hi[leaf]


def leaf_shapley(x, value, z, lo, hi, rows: int = 64):
    """(rows, features): the sum over the leaves of one tree."""
    import numpy as np
    used = np.flatnonzero((z != 1).any(0) | np.isfinite(lo).any(0) | np.isfinite(hi).any(0))
    on_path = np.isfinite(lo) | np.isfinite(hi)
    out = np.zeros(x.shape)
    if not len(used):
        return out
    t, wt = np.polynomial.legendre.leggauss(max(1, (int(on_path.sum(1).max()) + 1) // 2))
    t, wt = (t + 1) / 2, wt / 2
    z, lo, hi = z[:, used], lo[:, used], hi[:, used]
    for a in range(0, len(x), rows):
        part = x[a:a + rows, None, used]
        o = (part > lo) & (part <= hi)                            # rows x leaves x features
        total = np.zeros((o.shape[0], len(used)))
        for tq, wq in zip(t, wt, strict=True):
            terms = z * (1 - tq) + o * tq
            whole = terms.prod(2)
            total += wq * np.einsum("rl,rlf->rf", whole * value, (o - z) / terms)
        out[a:a + rows, used] = total
    return out


def permuted_rows(rows: DataFrame, repeats: int, key: str = "id", seed: int = 42) -> DataFrame:
    """key, label, x, rep, other: for each repeat, ``other`` is the x of the next row in a seeded order
    (the last row's is the first's).  One exact order for all repeats, one equi-join."""
    r = rows.select(key, "label", "x").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = global_positions(r.withColumn("__h", F.xxhash64(key, F.col("rep") + seed)), ["__h", key], ["rep"], out="__p").drop("__h")
    n = rows.count()
    nxt = placed.select(F.col("rep").alias("__r"), F.pmod(F.col("__p") - 1, F.lit(max(n, 1))).alias("__q"), F.col("x").alias("other"))
    return placed.join(nxt, (F.col("rep") == F.col("__r")) & (F.col("__p") == F.col("__q"))).select(key, "label", "x", "rep", "other")


def permutation_importance(rows: DataFrame, predict, features: list[str], repeats: int = 10, key: str = "id", seed: int = 42,
                           keep: bool = False) -> DataFrame:
    """SEL-06 / XPL-06: mean AUC drop over ``repeats`` permutations of each feature (negative -> 0; ``keep``
    leaves the sign).  ``predict``: x (rows, features) -> probability, called in the tasks.

    All (feature, repeat) variants of a row are scored where the row is (a forest goes down again only where the feature takes
    another side, ``ForestPredictor.changed``); blocks of distinct scores are shuffled, and every AUC comes from one grouped rank sum."""
    import numpy as np
    import pyarrow as pa
    width = len(features)

    changed = getattr(predict, "changed", None)

    def variants(batches):
        held, many = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                many += b.num_rows
            if many >= AUC_ROWS:
                yield from counted(held)
                held, many = [], 0
        yield from counted(held)

    def counted(held):
        """Rows with each distinct score, by variant and range of scores."""
        if not held:
            return
        rep, label = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("rep", "label"))
        parts = [tuple(b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) for c in ("x", "other")) for b in held]
        if changed:
            each = np.concatenate([changed(x, other) for x, other in parts], 1)
        else:
            each = np.empty((1 + width, len(rep)))
            x, other = (np.concatenate(c) for c in zip(*parts, strict=True))
            each[0] = predict(x)
            for f in range(width):
                kept = x[:, f].copy()
                x[:, f] = other[:, f]
                each[1 + f], x[:, f] = predict(x), kept
        for f, score in enumerate(each, -1):
            cell = np.floor(np.clip(score, 0.0, 1.0) * AUC_CELLS).astype(np.int64) + rep.astype(np.int64) * (AUC_CELLS + 1)
            order = np.lexsort((score, cell))
            cell, score, yes = cell[order], score[order], (label == 1)[order].astype(np.int32)
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (score[1:] != score[:-1])])
            cell, score, p = cell[first], score[first], np.add.reduceat(yes, first)
            q = np.diff(np.r_[first, len(order)]) - p
            ends = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            blocks = [[pa.py_buffer(v[a:b].astype(kind)).to_pybytes() for a, b in zip(ends, ends[1:], strict=False)] for v, kind in ((score, "f8"), (p, "i4"), (q, "i4"))]
            at = cell[ends[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array((at // (AUC_CELLS + 1)).astype(np.int32)),
                                              pa.array((at % (AUC_CELLS + 1)).astype(np.int32)), *map(pa.array, blocks)],
                                             names=["f", "rep", "cell", "scores", "ps", "qs"])

    dealt = permuted_rows(rows, repeats, key, seed).select("x", "other", "rep", F.col("label").cast("int").alias("label"))
    # few bytes, much work: by rows, not by size
    scores = (dealt.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
              .mapInArrow(variants, "f int, rep int, cell int, scores binary, ps binary, qs binary"))
    drops = grouped_auc(scores, ["f", "rep"])
    base = drops.where("f = -1").select("rep", F.col("auc").alias("whole"))
    names = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    g = (drops.where("f >= 0").join(base, "rep").groupBy(names.alias("feature"))
         .agg(F.avg(F.col("whole") - F.col("auc")).alias("perm_mean"), F.stddev_pop(F.col("whole") - F.col("auc")).alias("perm_std")))
    return g if keep else g.select("feature", F.greatest("perm_mean", F.lit(0.0)).alias("perm_mean"), "perm_std")


def grouped_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """AUC (ties count half) of (label, score) per group.  Scores are cut into ranges first, so that no group's scores pass one
    task.  ``scores`` may also have a range's distinct scores and their rows of both classes in blocks (cell, scores, ps, qs)."""
    ensure_checkpoint_dir(scores.sparkSession)
    if "scores" in scores.columns:
        cells = _cell_sums(scores, by).checkpoint(eager=True)              # read twice below; the scores are made once
    else:
        per = scores.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
        per = per.withColumn("cell", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * 4096))
        inside = Window.partitionBy(*by, "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        less = F.coalesce(F.sum("q").over(inside), F.lit(0))
        cells = (per.withColumn("u", F.col("p") * (less + F.col("q") / 2)).groupBy(*by, "cell")
                 .agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q")).checkpoint(eager=True))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("below", F.coalesce(F.sum("q").over(before), F.lit(0)))
    s = ranked.groupBy(*by).agg(F.sum(F.col("u") + F.col("p") * F.col("below")).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return s.select(*by, F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).alias("auc"))


def _cell_sums(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, cell, u, p, q: rank sum inside each range of scores and its rows of both classes."""
    import numpy as np
    import pyarrow as pa

    def summed(batches):
        for b in batches:
            out = []
            for some in b.column(len(by) + 1):
                score, p, q = (np.concatenate([np.frombuffer(v, kind) for v in some.values.field(c).to_pylist()]) for c, kind in (("scores", "f8"), ("ps", "i4"), ("qs", "i4")))
                order = np.argsort(score, kind="stable")
                score, p, q = score[order], p[order].astype(np.int64), q[order].astype(np.int64)
                first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
                p, q = np.add.reduceat(p, first), np.add.reduceat(q, first)
                out.append((float((p * (np.cumsum(q) - q + q / 2)).sum()), int(p.sum()), int(q.sum())))
            u, p, q = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(u, pa.float64()), pa.array(p, pa.int64()), pa.array(q, pa.int64())],
                                             names=[*by, "cell", "u", "p", "q"])

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in (*by, "cell"))
    return (blocks.groupBy(*by, "cell").agg(F.collect_list(F.struct("scores", "ps", "qs")).alias("some"))
            .mapInArrow(summed, f"{kinds}, u double, p long, q long"))


def influence_table(mdi: DataFrame, shap: DataFrame, perm: DataFrame) -> DataFrame:
    """XPL-06: full outer merge of the three importances, min-ranks, their mean to 2 decimals, the
    min-rank of that, and the influence label by 0.15 n and 0.85 n.  One row per feature."""
    j = (mdi.select("feature", F.col("importance").alias("mdi"))
         .join(shap.select("feature", "mean_abs_shap"), "feature", "full_outer")
         .join(perm.select("feature", F.col("perm_mean").alias("perm")), "feature", "full_outer")
         .fillna(0.0))
    names = ("mdi", "mean_abs_shap", "perm")
    r = j.select("feature", *names, *[F.rank().over(Window.orderBy(F.col(c).desc())).alias(f"rank_{c}") for c in names],
                 F.count(F.lit(1)).over(Window.partitionBy()).alias("n_features"))
    r = r.withColumn("mean_rank", np_round(sum((F.col(f"rank_{c}") for c in names), F.lit(0)) / F.lit(3.0), 2))
    r = r.withColumn("composite_rank", F.rank().over(Window.orderBy("mean_rank")))
    return r.withColumn("influence", F.when(F.col("composite_rank") >= F.col("n_features") * 0.85, "Least Useful")
                        .when(F.col("composite_rank") <= F.col("n_features") * 0.15, "Most Influential")
                        .otherwise("Moderate"))


def weak_features(influence: DataFrame, weak_pct: float = 0.2, shap_min: float = 0.0005) -> DataFrame:
    """RFN-01: weak-feature vote - among the max(1, int(0.2 n)) features with the largest composite
    rank (ties: first by name), SHAP under 0.0005, permutation importance <= 0; at least two
    votes drop a feature.  The criteria are joined by '|'."""
    place = F.row_number().over(Window.orderBy(F.col("composite_rank").desc(), "feature"))
    bottom = F.greatest(F.lit(1), F.floor(F.col("n_features") * F.lit(weak_pct)))
    v = influence.select("feature", (place <= bottom).alias("low_rank"), (F.col("mean_abs_shap") < shap_min).alias("low_shap"),
                         (F.col("perm") <= 0).alias("zero_perm"))
    names = ("low_rank", "low_shap", "zero_perm")
    votes = sum((F.col(c).cast("int") for c in names), F.lit(0))
    criteria = F.concat_ws("|", *[F.when(F.col(c), c) for c in names])
    return v.select("feature", votes.alias("votes"), criteria.alias("reasons"), (votes >= 2).alias("drop"))


def diagnosis(train_score, val_score):
    """RFN-03: fit diagnosis of the last point of a learning curve."""
    gap = train_score - val_score
    return (F.when((train_score > 0.85) & (gap > 0.10), "Overfit").when((val_score < 0.60) & (gap < 0.05), "Underfit")
            .when(gap > 0.06, "High Variance").when(train_score < 0.70, "High Bias").otherwise("Good Fit"))


def final_selection(results: DataFrame, curves: DataFrame) -> DataFrame:
    """RFN-05: weighted score .35 AUC + .30 F1 + .20 recall + .10 precision + .05 accuracy, less .04
    for a learning curve that overfits or has high variance and .02 for one that underfits;
    ranked.  ``curves``: model, diagnosis (a model without a curve is not penalised)."""
    s = (F.lit(0.35) * F.col("test_auc") + F.lit(0.30) * F.col("test_f1") + F.lit(0.20) * F.col("test_recall")
         + F.lit(0.10) * F.col("test_precision") + F.lit(0.05) * F.col("test_accuracy"))
    d = F.coalesce("diagnosis", F.lit("N/A"))
    pen = F.when(d.isin("Overfit", "High Variance"), -0.04).when(d == "Underfit", -0.02).otherwise(0.0)
    return (results.join(curves.select("model", "diagnosis"), "model", "left")
            .select("model", F.round(s, 6).alias("weighted"), pen.alias("penalty"), F.round(s + pen, 6).alias("final_score"),
                    d.alias("diagnosis"))
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("final_score").desc(), "model"))))
