"""OUT-04 isolation forest (not in Spark ML), built Spark-first.

* sample: every tree draws from all rows, keeping the 256 smallest of its own hash of
  the key; rows whose hash cannot be among them are dropped in the scan, so at most
  about 200 x 2048 (tree, row) pairs are shuffled, whatever the table's size;
* build: ``groupBy('tree').applyInPandas`` grows the 200 trees in parallel;
* the forest is bounded (200 trees x <= 511 nodes) so it is broadcast;
* score: ``mapInPandas`` walks all trees for an Arrow batch at a time (vectorised
  numpy), giving sklearn's ``score_samples`` = -2^(-E[h]/c(psi));
* offset = the ``contamination`` quantile of training scores;
  ``if_anomaly_score`` = score - offset (negative = anomalous), ``if_anomaly`` = 1 below 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_TREES = 200
PSI = 256
EULER = 0.5772156649015329


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _build_tree(pdf: pd.DataFrame, columns: list[str], seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed * 100003 + tree)
    X = pdf[columns].to_numpy(dtype=float)
    max_depth = int(math.ceil(math.log2(max(len(X), 2))))
    rows = []  # node, feature, threshold, left, right, size, depth

    def grow(idx, depth):
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            rows[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left_idx, right_idx = idx[sub[:, f] < t], idx[sub[:, f] >= t]
        left = grow(left_idx, depth + 1)
        right = grow(right_idx, depth + 1)
        rows[node] = (node, f, t, left, right, len(idx), depth)
        return node

    grow(np.arange(len(X)), 0)
    out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree)
    return out


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long, depth int"


@dataclass
class IsolationForestModel:
    columns: list
    nodes: pd.DataFrame          # the whole forest (bounded: n_trees x <= 2*psi-1 rows)
    offset: float = -0.5
    psi: int = PSI

    def prepared(self) -> list[tuple]:
        """(feature, threshold, left, right, path length at the node) arrays of each tree."""
        out = []
        for _, t in self.nodes.groupby("tree"):
            t = t.sort_values("node")
            path = t["depth"].to_numpy() + np.array([c_factor(s) for s in t["size"]])
            out.append((*(t[c].to_numpy() for c in ("feature", "threshold", "left", "right")), path))
        return out

    def _path_lengths(self, X: np.ndarray, trees: list[tuple]) -> np.ndarray:
        total = np.zeros(len(X))
        for feat, thr, left, right, path in trees:
            cur = np.zeros(len(X), dtype=int)
            active = np.flatnonzero(feat[cur] >= 0)
            while len(active):
                at = cur[active]
                cur[active] = np.where(X[active, feat[at]] < thr[at], left[at], right[at])
                active = active[feat[cur[active]] >= 0]
            total += path[cur]
        return total / max(len(trees), 1)

    def score_samples(self, X: np.ndarray, trees: list[tuple] | None = None) -> np.ndarray:
        return -np.power(2.0, -self._path_lengths(X, trees or self.prepared()) / c_factor(self.psi))

    def transform(self, df: DataFrame, digits: int = 6) -> DataFrame:
        cols, offset, model = list(self.columns), self.offset, self
        sc = df.sparkSession.sparkContext
        bmodel = sc.broadcast(model)
        from pyspark.sql import types as T
        out_schema = T.StructType(df.schema.fields + [T.StructField("if_anomaly", T.IntegerType()),
                                                      T.StructField("if_anomaly_score", T.DoubleType())])

        def score(batches):
            m = bmodel.value
            trees = m.prepared()
            for pdf in batches:
                X = pdf[cols].astype(float).fillna(0.0).to_numpy()
                s = m.score_samples(X, trees) - offset if len(X) else np.zeros(0)
                pdf["if_anomaly"] = (s < 0).astype("int32")
                pdf["if_anomaly_score"] = np.round(s, digits)
                yield pdf
        return df.mapInPandas(score, out_schema)


SPARE = 8                 # times psi rows per tree that pass the scan on average
_RANGE = 1 << 40


def tree_samples(rows: DataFrame, key: str, n_trees: int, psi: int, seed: int) -> DataFrame:
    """``rows`` + ``tree``: for each tree the ``psi`` rows with the smallest hash of (key, tree), of all rows."""
    limit = int(_RANGE * min(1.0, SPARE * psi / max(rows.count(), 1)))
    h = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(_RANGE))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: h(t) < limit)
    order = Window.partitionBy("tree").orderBy("__h", key)        # about SPARE x psi rows each
    return (rows.select("*", F.explode(trees).alias("tree")).withColumn("__h", h(F.col("tree")))
            .withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= psi).drop("__h", "__r"))


def fit_isolation_forest(train: DataFrame, columns: list[str], key: str = "id", n_trees: int = N_TREES,
                         psi: int = PSI, contamination: float = 0.05, seed: int = 42) -> IsolationForestModel:
    """Fit on ``train`` (NULL features -> 0).  Only the sampled rows (<= n_trees x psi)
    ever reach Python; the offset is an approximate quantile over all training scores."""
    sample = tree_samples(train.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]),
                          key, n_trees, psi, seed)
    nodes = (sample.groupBy("tree")
             .applyInPandas(lambda pdf: _build_tree(pdf, columns, seed), NODE_SCHEMA)
             .toPandas())  # bounded: n_trees x (2 psi - 1) rows
    model = IsolationForestModel(columns, nodes, 0.0, psi)
    scored = model.transform(train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]),
                             digits=12)
    offset = scored.agg(F.percentile_approx("if_anomaly_score", contamination, 100000).alias("q")).first()["q"]
    model.offset = float(offset)
    return model
