"""Many model fits as one Spark job: search draws, folds, curve points (MDL-05..07, TUN, RFN).

A fit is (model, parameters, held-out fold, share of the training rows).  Up to ``TASK_ROWS`` rows
the fits themselves are what is distributed: they are dealt over groups by cost, the packed rows
are shuffled to each group, and a group fits its share and returns scores only.  Of a table beyond
that bound a task holds a share of the rows: the tasks of a barrier stage take the same steps of the same
fits and merge each step's sums (``shared``), and as many such stages as fit the cores run at a time.
"""

from __future__ import annotations

import base64
import json
import math
import os
import pickle
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.operators import trees as T

TASK_ROWS = 50_000
SHARE_ROWS = 200_000                         # rows of a larger table that a task holds, while there are cores for that
FITS, TREES = 3, 4                           # fits, and trees of a forest, whose steps are merged at once
RANGES = 20_000                              # ranges of scores, each of which is ranked on its own
SEED = 42
TEST = -1                                    # the fold number of test rows
MODELS = ("logistic_regression", "decision_tree", "random_forest", "extra_trees", "newton_boosting",
          "leafwise_boosting", "symmetric_boosting", "gradient_boosting")

# The comparison set's parameters (newton, leafwise and symmetric boosting take the
# parameters of the three second-order libraries, by algorithm).
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {"C": 1.0, "penalty": "l2"},
    "decision_tree": {"max_depth": 8, "min_samples_leaf": 10},
    "random_forest": {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 5, "max_features": "sqrt"},
    "extra_trees": {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 5, "max_features": "sqrt"},
    "newton_boosting": {"n_estimators": 400, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8,
                        "min_child_weight": 5},
    "leafwise_boosting": {"n_estimators": 400, "max_depth": 7, "learning_rate": 0.05, "num_leaves": 63, "subsample": 0.8,
                          "colsample_bytree": 0.8, "min_child_samples": 20},
    "symmetric_boosting": {"n_estimators": 400, "max_depth": 7, "learning_rate": 0.05, "reg_lambda": 3.0},
    "gradient_boosting": {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "min_samples_leaf": 10},
}


# ------------------------------------------------------------------ search spaces

def ints(lo: int, hi: int):
    """lo, ..., hi - 1."""
    return ("int", lo, hi)


def floats(lo: float, hi: float):
    return ("float", lo, hi)


def logs(lo: float, hi: float):
    return ("log", lo, hi)


# Ranges of the random search.
SPACES: dict[str, dict] = {
    "newton_boosting": {
        "n_estimators": ints(200, 800), "max_depth": ints(3, 10), "learning_rate": logs(0.01, 0.3), "subsample": floats(0.5, 1.0),
        "colsample_bytree": floats(0.5, 1.0), "colsample_bylevel": floats(0.5, 1.0), "min_child_weight": ints(1, 15),
        "gamma": logs(1e-4, 1.0), "reg_alpha": logs(1e-4, 10.0), "reg_lambda": logs(1e-4, 10.0), "scale_pos_weight": floats(8.0, 16.0)},
    "leafwise_boosting": {
        "n_estimators": ints(200, 800), "max_depth": ints(4, 12), "num_leaves": ints(20, 150), "learning_rate": logs(0.01, 0.2),
        "subsample": floats(0.5, 1.0), "colsample_bytree": floats(0.5, 1.0), "min_child_samples": ints(5, 50),
        "reg_alpha": logs(1e-4, 10.0), "reg_lambda": logs(1e-4, 10.0), "min_split_gain": floats(0.0, 0.5)},
    "random_forest": {
        "n_estimators": ints(100, 600), "max_depth": ints(5, 20), "min_samples_split": ints(2, 20), "min_samples_leaf": ints(1, 15),
        "max_features": ["sqrt", "log2", 0.3, 0.5, 0.7], "max_samples": floats(0.6, 1.0), "min_impurity_decrease": floats(0.0, 0.01)},
    "extra_trees": {
        "n_estimators": ints(100, 600), "max_depth": ints(5, 20), "min_samples_split": ints(2, 20), "min_samples_leaf": ints(1, 15),
        "max_features": ["sqrt", "log2", 0.3, 0.5, 0.7], "min_impurity_decrease": floats(0.0, 0.01)},
    "gradient_boosting": {
        "n_estimators": ints(100, 500), "max_depth": ints(3, 8), "learning_rate": logs(0.01, 0.2), "subsample": floats(0.5, 1.0),
        "min_samples_leaf": ints(5, 30), "max_features": ["sqrt", "log2", 0.5, 0.7, None], "min_impurity_decrease": floats(0.0, 0.005)},
    "logistic_regression": {"C": logs(1e-3, 100.0), "penalty": ["l1", "l2", "elasticnet"], "l1_ratio": floats(0.0, 1.0), "max_iter": ints(500, 2000)},
    "decision_tree": {
        "max_depth": ints(3, 20), "min_samples_split": ints(2, 30), "min_samples_leaf": ints(1, 20),
        "max_features": ["sqrt", "log2", None, 0.5, 0.7], "criterion": ["gini", "entropy"], "min_impurity_decrease": floats(0.0, 0.01)},
}
# The axes of the second search.
GRIDS: dict[str, dict] = {
    "newton_boosting": {"n_estimators": [300, 400, 500], "max_depth": [4, 5, 6, 7], "learning_rate": [0.03, 0.05, 0.08],
                        "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.7, 0.8, 0.9], "min_child_weight": [3, 5, 8],
                        "scale_pos_weight": [10.0, 12.35, 15.0]},
    "leafwise_boosting": {"n_estimators": [300, 400, 500], "num_leaves": [31, 63, 95], "learning_rate": [0.03, 0.05, 0.08],
                          "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.7, 0.8, 0.9], "min_child_samples": [10, 20, 30]},
    "random_forest": {"n_estimators": [200, 300, 400], "max_depth": [8, 10, 12], "min_samples_leaf": [3, 5, 8], "max_features": ["sqrt", "log2", 0.5]},
    "extra_trees": {"n_estimators": [200, 300, 400], "max_depth": [8, 10, 12], "min_samples_leaf": [3, 5, 8], "max_features": ["sqrt", "log2", 0.5]},
    "gradient_boosting": {"n_estimators": [200, 300, 400], "max_depth": [3, 4, 5], "learning_rate": [0.03, 0.05, 0.08],
                          "subsample": [0.7, 0.8, 0.9], "min_samples_leaf": [5, 10, 15]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l2"]},
    "decision_tree": {"max_depth": [5, 8, 10, 12], "min_samples_leaf": [5, 10, 15], "max_features": ["sqrt", "log2", None],
                      "criterion": ["gini", "entropy"]},
}
# The parameter of each model's validation curve.
CURVES: dict[str, tuple[str, list]] = {
    "extra_trees": ("n_estimators", [50, 100, 150, 200, 250, 300, 400, 500]),
    "random_forest": ("n_estimators", [50, 100, 150, 200, 250, 300, 400, 500]),
    "newton_boosting": ("max_depth", [2, 3, 4, 5, 6, 7, 8, 9]),
    "leafwise_boosting": ("num_leaves", [15, 31, 47, 63, 79, 95, 127]),
    "gradient_boosting": ("max_depth", [2, 3, 4, 5, 6, 7]),
    "logistic_regression": ("C", [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]),
    "symmetric_boosting": ("max_depth", [3, 4, 5, 6, 7, 8]),
    "decision_tree": ("max_depth", [2, 3, 4, 5, 6, 8, 10, 12]),
}


def draw(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """TUN-01: n seeded draws; whole numbers, uniform and log-uniform ranges, lists."""
    r = random.Random(seed)

    def one(d):
        if isinstance(d, list):
            return r.choice(d)
        kind, lo, hi = d
        if kind == "int":
            return r.randrange(lo, hi)
        return r.uniform(lo, hi) if kind == "float" else math.exp(r.uniform(math.log(lo), math.log(hi)))

    return [{k: one(space[k]) for k in sorted(space)} for _ in range(n)]


def focused(best: dict, grid: dict, steps: int = 3) -> list[dict]:
    """TUN-02: all settings around the best draw: decimal axes +-25 % of the axis' width (inside it), whole
    numbers stepped, listed choices with their neighbours; what has no axis keeps its value."""
    axes = {}
    for k, v in best.items():
        axis = grid.get(k)
        numbers = [a for a in axis or [] if isinstance(a, (int, float))]
        if axis is None:
            axes[k] = [v]
        elif isinstance(v, float) and numbers:
            lo, hi = min(numbers), max(numbers)
            a, b = max(lo, v - 0.25 * (hi - lo)), min(hi, v + 0.25 * (hi - lo))
            axes[k] = sorted({round(a + (b - a) * i / (steps - 1), 6) for i in range(steps)})
        elif isinstance(v, int) and numbers:
            lo, hi = min(numbers), max(numbers)
            step = max(1, (hi - lo) // (2 * steps))
            reach = step * (steps // 2)
            axes[k] = list(range(max(lo, v - reach), min(hi + 1, v + reach + 1), step)) or [v]
        else:
            i = axis.index(v) if v in axis else -1
            axes[k] = [v] if i < 0 else axis[max(0, i - 1):i + 2]
    out = [{}]
    for k in sorted(axes):
        out = [{**s, k: v} for s in out for v in axes[k]]
    return out


# ------------------------------------------------------------------ one fit (in a task)

@dataclass
class Fit:
    """``fold``: the fold that is held out; TEST: all training rows fit, the test rows are held out.
    ``share``: of the training rows, nested by row hash.  ``marks``: score after so many trees, too."""
    model: str
    params: dict = field(default_factory=dict)
    fold: int = TEST
    share: float = 1.0
    marks: tuple = ()

    def cost(self) -> float:
        p = DEFAULTS[self.model] | self.params
        each = {"logistic_regression": 20, "decision_tree": 30, "random_forest": 25, "extra_trees": 25}.get(self.model, 3 + 2 * min(p.get("max_depth", 6), 10))
        return each * self.share * p.get("n_estimators", 1)


@dataclass
class Rows:
    """Rows of a task: ids (hashes), x float32 (None: not needed), class, fold, codes by ``edges``."""
    rid: np.ndarray
    x: np.ndarray | None
    y: np.ndarray
    fold: np.ndarray
    edges: list
    codes: np.ndarray
    shared: tuple[int, int] | None = None    # its place among the tasks that hold more rows


def n_features(choice, width: int) -> int:
    if choice is None:
        return width
    if choice == "sqrt":
        return max(1, int(math.sqrt(width)))
    if choice == "log2":
        return max(1, int(math.log2(width)))
    return max(1, int(choice * width))


def balanced(n: int, n1: int) -> tuple[float, float]:
    n0 = n - n1
    return (n / (2 * n0) if n0 else 1.0, n / (2 * n1) if n1 else 1.0)


def moments(means: list, stds: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of all rows from those of each part."""
    if len(counts) == 1:
        return means[0], stds[0]
    part, n = np.array(counts)[:, None], max(int(sum(counts)), 1)
    mean = (part * np.array(means)).sum(0) / n
    return mean, np.sqrt((part * (np.array(stds) ** 2 + (np.array(means) - mean) ** 2)).sum(0) / n)


def forest_specs(model: str, p: dict, width: int, class_weight: tuple[float, float], n_rows: int) -> list[T.Spec]:
    forest = model != "decision_tree"
    return [T.Spec(seed=SEED * 100_003 + k, n_candidates=n_features(p.get("max_features"), width), max_depth=p.get("max_depth", 62),
                   min_split=p.get("min_samples_split", 2), min_leaf=p.get("min_samples_leaf", 1), min_decrease=p.get("min_impurity_decrease", 0.0),
                   extra=model == "extra_trees", bootstrap=model == "random_forest", entropy=p.get("criterion") == "entropy",
                   class_weight=class_weight, total=float(n_rows)) for k in range(p["n_estimators"] if forest else 1)]


def tree_weights(spec: T.Spec, rid: np.ndarray, train: np.ndarray, p: dict) -> np.ndarray:
    if not spec.bootstrap:
        return train.astype(np.int64)
    kept = train & (T.uniform(spec.seed, 9, rid) < p.get("max_samples", 1.0))
    return T.poisson_weights(spec.seed, rid) * kept


def boosting(model: str, p: dict, class_weight: tuple[float, float]) -> T.Boost:
    ratio = class_weight[1] / class_weight[0]
    return T.Boost(
        rounds=p["n_estimators"], rate=p["learning_rate"], max_depth=p["max_depth"], l1=p.get("reg_alpha", 0.0),
        l2=p.get("reg_lambda", 1.0 if model == "newton_boosting" else 0.0), min_gain=p.get("gamma", p.get("min_split_gain", 0.0)),
        min_child_weight=p.get("min_child_weight", 1e-3 if model == "leafwise_boosting" else 0.0),
        min_leaf=p.get("min_child_samples", p.get("min_samples_leaf", 1)), row_share=p.get("subsample", 1.0),
        column_share=p.get("colsample_bytree", 1.0),
        level_share=p.get("colsample_bylevel", 1.0), num_leaves=p.get("num_leaves", 1 << 30),
        shape={"leafwise_boosting": "leaves", "symmetric_boosting": "symmetric"}.get(model, "depth"),
        variance=model == "gradient_boosting", positive_weight=p.get("scale_pos_weight", ratio), seed=SEED)


def places(fit: Fit, d: Rows) -> np.ndarray:
    """Places of the rows that ``fit`` learns from or holds out."""
    train = (d.fold >= 0) & (d.fold != fit.fold)
    if fit.share < 1:
        train &= T.uniform(SEED, 3, d.rid) < fit.share
    return np.flatnonzero(train | (d.fold == fit.fold))


def concerned(fit: Fit, d: Rows) -> Rows:
    """Those rows."""
    keep = places(fit, d)
    if len(keep) == len(d.y):
        return d
    return Rows(d.rid[keep], None if d.x is None else d.x[keep], d.y[keep], d.fold[keep], d.edges, d.codes[keep], d.shared)


def coded(fits: list[Fit]) -> bool:
    """Whether codes are all that the fits read of a row."""
    return all("boosting" in f.model for f in fits)


def probabilities(fit: Fit, d: Rows) -> dict[int, np.ndarray]:
    """{number of trees (0: the whole model): probability of class 1 of every row of ``concerned``}."""
    return T.alone(fitting(fit, d))


def fitting(fit: Fit, d: Rows, sides: tuple = ("held_out", "train")):
    """``probabilities`` of this task's rows (see ``trees`` for the steps), of those of ``sides`` at least."""
    p = DEFAULTS[fit.model] | fit.params
    train = d.fold != fit.fold
    n, n1 = (int(a) for a in (yield [(T.total, train.sum()), (T.total, d.y[train].sum())]))
    weight = balanced(n, n1)
    if fit.model == "logistic_regression":
        mine, kind = d.x[train], np.float64 if d.shared else None
        own = [mine.mean(0, kind), mine.std(0, kind)] if len(mine) else [np.zeros(d.x.shape[1])] * 2
        mean, std = moments(*(yield [(list, own[0]), (list, own[1]), (list, len(mine))]))
        z = (d.x - mean) / np.where(std > 0, std, 1.0)
        w = np.where(d.y == 1, weight[1], weight[0])
        ratio = {"l1": 1.0, "l2": 0.0}.get(p["penalty"], p.get("l1_ratio", 0.5))
        b, a = yield from (T.solved_in_few if d.shared else T.solved)(z[train].astype(np.float64), d.y[train], w[train], p["C"], ratio, p.get("max_iter", 1000))
        return {0: 1.0 / (1.0 + np.exp(-(z @ b + a)))}
    if "boosting" in fit.model:
        margin, at, _, _ = yield from T.boosted(boosting(fit.model, p, weight), d.codes, d.y, train, d.rid, marks=fit.marks, part=d.shared)
        return {k: 1.0 / (1.0 + np.exp(-m)) for k, m in ({0: margin} | at).items()}
    asked = np.flatnonzero(~train) if sides == ("held_out",) else np.arange(len(train))
    total, out, scored_x = np.zeros(len(asked)), {}, d.x if len(asked) == len(train) else d.x[asked]
    specs = forest_specs(fit.model, p, d.x.shape[1], weight, n)
    x, codes = (d.x.copy("F"), None) if specs[0].extra else (None, d.codes.copy("F"))       # a feature's values side by side

    def whole(k: int) -> np.ndarray:
        prob = np.zeros(len(train))
        prob[asked] = total / k
        return prob

    for at in range(0, len(specs), TREES):
        grown = yield from T.together([T.growing(s, x, codes, d.edges, d.y, tree_weights(s, d.rid, train, p), part=d.shared)
                                            for s in specs[at:at + TREES]])
        for k, tree in enumerate(grown, at + 1):
            node, feature, threshold, n0, n1 = tree.arrays()
            total += T.share(n0, n1, weight)[T.leaf_of(scored_x, node, feature, threshold)]
            if k in fit.marks:
                out[k] = whole(k)
    return out | {0: whole(len(specs))}


NAMES = ("auc", "f1", "recall", "precision", "accuracy", "tn", "fp", "fn", "tp")


def scored(fit: Fit, d: Rows) -> list[tuple]:
    """(mark, set, metrics) on the held-out rows and on the training rows."""
    out, d = [], concerned(fit, d)
    for mark, prob in probabilities(fit, d).items():
        for name, rows in (("held_out", d.fold == fit.fold), ("train", d.fold != fit.fold)):
            m = T.metrics(d.y[rows], prob[rows])
            out.append((mark, name, *(float(m[k]) for k in NAMES)))
    return out


# ------------------------------------------------------------------ many fits (Spark)

def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """At most BINS - 1 cut points of each feature: its quantiles, in one aggregate (width x BINS numbers)."""
    at = [k / T.BINS for k in range(1, T.BINS)]
    got = rows.where(f"fold <> {TEST}").agg(*[F.percentile_approx(F.col("x")[f], at, 20_000).alias(f"f{f}") for f in range(width)],
                                             *[F.max(F.col("x")[f]).alias(f"m{f}") for f in range(width)]).first()
    out = []
    for f in range(width):
        e = np.unique(np.array(got[f"f{f}"] or [], np.float32))
        out.append(e[e < got[f"m{f}"]] if len(e) else e)       # nothing lies above the greatest value
    return out


def packed(rows: DataFrame, width: int) -> DataFrame:
    """(rid, x, y, fold) as binary blocks, one row for each batch."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), x, b.column(2).to_numpy(zero_copy_only=False).astype(np.int8),
                         b.column(3).to_numpy(zero_copy_only=False).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], names=["rid", "x", "y", "fold"])
    return rows.select(F.xxhash64("id").alias("rid"), "x", "label", "fold").mapInArrow(pack, "rid binary, x binary, y binary, fold binary")


def unpack(blocks: list[dict], width: int, edges: list[np.ndarray]) -> Rows:
    cat = lambda k, kind: np.frombuffer(b"".join(b[k] for b in blocks), kind)
    rid = cat("rid", np.int64)
    order = np.argsort(rid, kind="stable")           # whatever order the blocks came in
    x = cat("x", np.float32).reshape(-1, width)[order]
    return Rows(rid[order], x, cat("y", np.int8)[order].astype(np.int64), cat("fold", np.int32)[order], edges, T.bin_codes(x, edges))


def deal(fits: list[Fit], groups: int) -> list[list[int]]:
    """Fits by group: the dearest first, each to the group with the least to do."""
    todo, load = [[] for _ in range(groups)], np.zeros(groups)
    for i in sorted(range(len(fits)), key=lambda i: -fits[i].cost()):
        g = int(load.argmin())
        todo[g].append(i)
        load[g] += fits[i].cost()
    return todo


class Exchange:
    """What the tasks of a barrier stage tell each other: each writes a file for a step to the folder that driver and executors
    share, and reads the others' (``allGather``, which takes a second a step, where that folder is no mounted one)."""

    def __init__(self, folder: str):
        self.tasks, self.step = BarrierTaskContext.get(), 0
        self.me, self.many = self.tasks.partitionId(), len(self.tasks.getTaskInfos())
        run = self.tasks.allGather(uuid.uuid4().hex)[0]                    # a new one for each attempt
        scheme, _, path = folder.rpartition(":")
        self.at = os.path.join("/" + path.lstrip("/"), f"steps-{run}") if scheme in ("", "file") else None
        if self.at:
            os.makedirs(self.at, exist_ok=True)

    def file(self, step: int, task: int) -> str:
        return os.path.join(self.at, f"{step}-{task}")

    def all(self, mine: bytes) -> list[bytes]:
        """Every task's bytes of this step, in the order of the tasks."""
        if not self.at:
            return [base64.b64decode(m) for m in self.tasks.allGather(base64.b64encode(mine).decode())]
        name = self.file(self.step, self.me)
        with open(name + ".part", "wb") as f:
            f.write(mine)
        os.replace(name + ".part", name)
        out = []
        for task in range(self.many):
            while task != self.me and not os.path.exists(self.file(self.step, task)):
                time.sleep(0.0005)
            out.append(mine if task == self.me else open(self.file(self.step, task), "rb").read())
        if self.step:
            os.remove(self.file(self.step - 1, self.me))                   # all have read it: they have written this step's
        self.step += 1
        return out

    def close(self) -> None:
        self.tasks.barrier()
        if self.at and self.step:
            os.remove(self.file(self.step - 1, self.me))


def shared(steps, peers: Exchange):
    """What a fit returns whose rows are dealt over the tasks of this barrier stage: each step's arrays are merged over all
    of them, in the same order in each task."""
    got = None
    try:
        while True:
            asked = steps.send(got)
            mine = [np.ascontiguousarray(a) for _, a in asked]
            sent = [pickle.loads(m) for m in peers.all(pickle.dumps(mine, 5))]
            got = [merge([m[i].reshape((-1, *np.shape(a)[1:]) if np.ndim(a) else ()) for m in sent]) for i, (merge, a) in enumerate(asked)]
    except StopIteration as end:
        return end.value


def dealt(rows: DataFrame, width: int, edges: list[np.ndarray], tasks: int, work: Callable, schema: str, codes_only: bool = False) -> DataFrame:
    """``work(rows, ids, peers)`` over the rows dealt by hash over the ``tasks`` tasks of one barrier stage.  With ``codes_only``
    a task gets a byte for each feature in place of x."""
    from roadlens.operators.bagging import packed_codes, unpacked_codes
    from roadlens.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(rows.sparkSession)
    names, kind = ["id", "rid", "label", "fold", "x", "g"], rows.schema["id"].dataType.simpleString()

    def values(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([packed_codes(T.bin_codes(values(c), edges)) if n == "x" else c for n, c in zip(names, b.columns, strict=True)], names=names)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (lambda c: unpacked_codes(c, width).copy()) if codes_only else values
        number = lambda k, to: lambda b: b.column(k).to_numpy(zero_copy_only=False).astype(to)
        each = {"rid": number(1, np.int64), "y": number(2, np.int64), "fold": number(3, np.int32), "x": lambda b: read(b.column(4))}
        parts = {"rid": [np.zeros(0, np.int64)], "y": [np.zeros(0, np.int64)], "fold": [np.zeros(0, np.int32)],      # a task without rows
                 "x": [np.zeros((0, width), np.uint8 if codes_only else np.float32)]}                                # takes the steps, too
        ids = []
        for b in batches:
            if b.num_rows:
                ids.append(pa.concat_arrays([b.column(0)]))
                for k, get in each.items():
                    parts[k].append(get(b))
        order = np.argsort(np.concatenate(parts["rid"]), kind="stable")
        rid, y, fold, x = (np.concatenate(parts.pop(k))[order] for k in ("rid", "y", "fold", "x"))
        ids = pa.chunked_array(ids).take(pa.array(order)) if ids else None
        del order
        peers = Exchange(folder)
        d = Rows(rid, None if codes_only else x, y, fold, edges, x if codes_only else T.bin_codes(x, edges), (peers.me, peers.many))
        yield from work(d, ids, peers)
        peers.close()

    at = F.pmod(F.xxhash64("id", "label", "x"), F.lit(tasks)).cast("int").alias("g")
    sent = rows.select("id", F.xxhash64("id").alias("rid"), "label", "fold", "x", at)
    if codes_only:
        label, fold = (rows.schema[c].dataType.simpleString() for c in ("label", "fold"))
        sent = sent.mapInArrow(code, f"id {kind}, rid long, label {label}, fold {fold}, x binary, g int")
    return (sent.repartitionById(tasks, "g").select("id", "rid", "label", "fold", "x").mapInArrow(worked, schema, barrier=True))


def ranked(scores: DataFrame) -> DataFrame:
    """fit, mark, held and the metrics of ``scores`` (fit, mark, held, score, pos, neg: rows of each class with that score): the
    AUC from the ranks inside each range of scores and the rows of the ranges below."""
    each, at = ["fit", "mark", "held"], F.floor(F.col("score") * RANGES).alias("at")
    v = scores.groupBy(*each, at, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = lambda w: F.sum("neg").over(w) - F.col("neg")
    yes = lambda c: F.sum(F.when(F.col("score") >= 0.5, F.col(c)).otherwise(0))
    v = (v.withColumn("under", below(Window.partitionBy(*each, "at").orderBy("score"))).groupBy(*each, "at")
         .agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
              yes("pos").alias("tp"), yes("neg").alias("fp")))
    v = (v.withColumn("under", below(Window.partitionBy(*each).orderBy("at"))).groupBy(*each)
         .agg(F.sum(F.col("u") + F.col("pos") * F.col("under")).alias("u"), *[F.sum(c).cast("double").alias(c) for c in ("pos", "neg", "tp", "fp")]))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    part = lambda a, b, other: F.when(b > 0, a / b).otherwise(F.lit(other))
    return v.select(*each, part(F.col("u"), pos * neg, float("nan")).alias("auc"), part(2 * tp, tp + fp + pos, 0.0).alias("f1"),
                    part(tp, pos, 0.0).alias("recall"), part(tp, tp + fp, 0.0).alias("precision"),
                    part(tp + neg - fp, pos + neg, 0.0).alias("accuracy"), (neg - fp).alias("tn"), "fp", (pos - tp).alias("fn"), "tp")


def run_shared(rows: DataFrame, n: int, fits: list[Fit], width: int, sides: tuple) -> list[tuple]:
    """``run`` for tables beyond TASK_ROWS: groups of fits at a time, the rows dealt over the tasks of each group."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(len(fits), cores // max(2, -(-n // SHARE_ROWS))))
    tasks, edges = min(-(-n // TASK_ROWS), max(1, cores // groups)), bin_edges(rows, width)

    def one(mine: list[int]) -> list[tuple]:
        def work(d: Rows, _, peers: Exchange) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(mine), FITS):
                some = mine[at:at + FITS]
                own = [concerned(fits[i], d) for i in some]
                got = shared(T.together([fitting(fits[i], o, sides) for i, o in zip(some, own, strict=True)]), peers)
                for i, o, marks in zip(some, own, got, strict=True):
                    for mark, prob in marks.items():
                        for side in sides:
                            rows = (o.fold == fits[i].fold) == (side == "held_out")
                            score, which = np.unique(prob[rows].astype(np.float64), return_inverse=True)
                            n1 = np.bincount(which, o.y[rows], len(score)).astype(np.int64)
                            n0 = np.bincount(which, minlength=len(score)) - n1
                            if peers.me == 0:                                  # a side without rows has metrics, too
                                score, n1, n0 = np.r_[score, 0.0], np.r_[n1, 0], np.r_[n0, 0]
                            k = len(score)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(k, i, np.int32)), pa.array(np.full(k, mark, np.int32)), pa.array([side] * k, pa.string()),
                                 pa.array(score), pa.array(n1), pa.array(n0)], names=["fit", "mark", "held", "score", "pos", "neg"])

        return [tuple(r) for r in ranked(dealt(rows, width, edges, tasks, work, "fit int, mark int, held string, score double, pos long, neg long",
                                                     coded([fits[i] for i in mine]))).collect()]

    with ThreadPoolExecutor(groups) as pool:
        return sorted((r for got in pool.map(one, [g for g in deal(fits, groups) if g]) for r in got),
                      key=lambda r: (r[0], r[1], r[2] == "held_out"))


def run(rows: DataFrame, fits: list[Fit], width: int, sides: tuple = ("held_out", "train")) -> DataFrame:
    """fit (its place in ``fits``), mark, held (held_out or train, those of ``sides`` at least) and the metrics.  ``rows``: id,
    label, fold, x (array of ``width`` floats)."""
    spark: SparkSession = rows.sparkSession
    schema = "fit int, mark int, held string, " + ", ".join(f"{n} double" for n in NAMES)
    if (n := rows.count()) > TASK_ROWS:
        return spark.createDataFrame(run_shared(rows, n, fits, width, sides), schema)
    edges = bin_edges(rows, width)
    todo = [g for g in deal(fits, min(len(fits), 4 * spark.sparkContext.defaultParallelism)) if g]
    copies = packed(rows, width).select(F.explode(F.sequence(F.lit(0), F.lit(len(todo) - 1))).alias("g"), "rid", "x", "y", "fold")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [r for batch in batches for r in batch.to_pylist()]       # one partition is one group
        if blocks:
            d = unpack(blocks, width, edges)
            for i in todo[blocks[0]["g"]]:
                cols = list(zip(*[(i, *r) for r in scored(fits[i], d)], strict=True))
                kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * len(NAMES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["fit", "mark", "held", *NAMES])

    return copies.repartitionById(len(todo), "g").mapInArrow(fitted, schema)


def described(fits: list[Fit], spark: SparkSession) -> DataFrame:
    """fit, model, params (JSON), fold, share."""
    return spark.createDataFrame([(i, f.model, json.dumps(f.params, sort_keys=True), f.fold, f.share) for i, f in enumerate(fits)],
                                 "fit int, model string, params string, fold int, share double")


FIVE = ("auc", "f1", "recall", "precision", "accuracy")


def fold_scores(rows: DataFrame, width: int, models: tuple = MODELS, folds: int = 5, sides: tuple = ("held_out", "train")) -> DataFrame:
    """model, fold (TEST: the fit on all training rows), held, metrics; one job for all models and folds."""
    fits = [Fit(m, fold=k) for m in models for k in (*range(folds), TEST)]
    return run(rows, fits, width, sides).join(F.broadcast(described(fits, rows.sparkSession)), "fit").select("model", "fold", "held", *NAMES)


def summary(scores: DataFrame) -> DataFrame:
    """Per model mean and standard deviation over the folds of five metrics, test metrics and confusion
    counts of the fit on all training rows; best test AUC first."""
    cv, test = F.col("fold") != TEST, F.col("fold") == TEST
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    out = scores.where("held = 'held_out'").groupBy("model").agg(
        *[f(F.when(cv, value(c))).alias(f"cv_{c}_{n}") for c in FIVE for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        *[F.max(F.when(test, value(c))).alias(f"test_{c}") for c in FIVE],
        *[F.max(F.when(test, F.col(c))).cast("int").alias(c) for c in ("tn", "fp", "fn", "tp")])
    return out.orderBy(F.col("test_auc").desc_nulls_last(), "model")


def last_points(scores: DataFrame) -> DataFrame:
    """model, train_mean, val_mean: mean AUC over the folds on the rows that fit and on those held out."""
    auc = lambda held: F.avg(F.when((F.col("held") == held) & ~F.isnan("auc"), F.col("auc")))
    return scores.where(f"fold <> {TEST}").groupBy("model").agg(auc("train").alias("train_mean"), auc("held_out").alias("val_mean"))


def compare(rows: DataFrame, width: int, models: tuple = MODELS, folds: int = 5) -> DataFrame:
    """MDL-07: the models side by side (``summary``)."""
    return summary(fold_scores(rows, width, models, folds, ("held_out",)))


def baselines(rows: DataFrame, width: int, models: tuple, folds: int = 5, objectives: tuple = ("f1", "auc", "recall")) -> DataFrame:
    """model, objective, baseline: CV score of each model's plain parameters."""
    got = fold_scores(rows, width, models, folds, ("held_out",)).where(f"fold <> {TEST} and held = 'held_out'")
    g = got.groupBy("model").agg(*[F.avg(F.nanvl(o, F.lit(0.0))).alias(o) for o in objectives])
    return g.select("model", F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), F.col(o).alias("baseline")) for o in objectives])).alias("v")).select(
        "model", "v.*")


def predictions(rows: DataFrame, fit: Fit, width: int) -> DataFrame:
    """id, label, score, pred of the rows that ``fit`` holds out."""
    held = rows.where(F.col("fold") == fit.fold).select("id", "label", F.xxhash64("id").alias("rid"))
    n, edges = rows.count(), bin_edges(rows, width)
    if n > TASK_ROWS:
        def work(d: Rows, ids, peers: Exchange) -> Iterator[pa.RecordBatch]:
            here, some = places(fit, d), concerned(fit, d)
            prob, out = shared(fitting(fit, some, ("held_out",)), peers)[0], some.fold == fit.fold
            if out.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(here[out])).combine_chunks(), pa.array(some.y[out].astype(np.int32)),
                                                  pa.array(prob[out].astype(np.float64))], names=["id", "label", "score"])

        tasks = min(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
        got = dealt(rows, width, edges, tasks, work, f"id {rows.schema['id'].dataType.simpleString()}, label int, score double", coded([fit]))
        return got.select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [r for batch in batches for r in batch.to_pylist()]
        if blocks:
            d = concerned(fit, unpack(blocks, width, edges))
            out = d.fold == fit.fold
            yield pa.RecordBatch.from_arrays([pa.array(d.rid[out]), pa.array(probabilities(fit, d)[0][out])], names=["rid", "score"])

    got = packed(rows, width).repartition(1).mapInArrow(fitted, "rid long, score double")    # TASK_ROWS at most
    return held.join(got, "rid").select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


OBJECTIVES = ("f1", "auc", "recall")


def search(rows: DataFrame, width: int, models: tuple, n_draws: int = 60, folds: int = 5, grids: bool = True,
           objectives: tuple = OBJECTIVES, checkpoint=None) -> DataFrame:
    """TUN-01/02: model, objective, params, cv_score (mean over the folds), search (random or grid).

    The draws of a model are the same for every objective, so one fit serves all; likewise a
    setting that several objectives' grids hold.  Settings are picked by CV score alone."""
    spark = rows.sparkSession

    def scores(settings: list[tuple[str, dict]]) -> DataFrame:
        fits = [Fit(m, p, k) for m, p in settings for k in range(folds)]
        got = run(rows, fits, width, ("held_out",)).where("held = 'held_out' and mark = 0").join(F.broadcast(described(fits, spark)), "fit")
        return got.groupBy("model", "params").agg(*[F.avg(F.coalesce(F.nanvl(o, F.lit(0.0)), F.lit(0.0))).alias(o) for o in objectives])

    long = lambda df, how: df.select("model", "params", F.lit(how).alias("search"), F.explode(F.array(*[
        F.struct(F.lit(o).alias("objective"), F.col(o).alias("cv_score")) for o in objectives])).alias("v")).select(
        "model", "v.objective", "params", "v.cv_score", "search")
    keep = checkpoint or (lambda df: df)
    drawn = keep(long(scores([(m, p) for m in models for p in draw(SPACES[m], n_draws)]), "random"))
    if not grids:
        return drawn
    best = drawn.groupBy("model", "objective").agg(F.max(F.struct("cv_score", "params")).alias("b")).select("model", "objective", "b.params").collect()
    around = {(r["model"], r["objective"]): focused(json.loads(r["params"]), GRIDS[r["model"]]) for r in best}
    settings = {(m, json.dumps(p, sort_keys=True)): (m, p) for (m, _), ps in around.items() for p in ps}
    wanted = spark.createDataFrame([(m, o, json.dumps(p, sort_keys=True)) for (m, o), ps in around.items() for p in ps],
                                   "model string, objective string, params string")
    grid = keep(long(scores(list(settings.values())), "grid").join(F.broadcast(wanted), ["model", "objective", "params"])
                .select("model", "objective", "params", "cv_score", "search"))
    return drawn.unionByName(grid)


def learning_curves(rows: DataFrame, width: int, models: tuple = MODELS, folds: int = 5, points: int = 10) -> DataFrame:
    """RFN-03: model, fraction, mean and standard deviation of train and validation AUC over the folds."""
    fits = [Fit(m, fold=k, share=s / points) for m in models for s in range(1, points + 1) for k in range(folds)]
    got = run(rows, fits, width).where("mark = 0").join(F.broadcast(described(fits, rows.sparkSession)), "fit")
    auc = lambda held: F.when((F.col("held") == held) & ~F.isnan("auc"), F.col("auc"))
    return got.groupBy("model", F.col("share").alias("fraction")).agg(
        F.avg(auc("train")).alias("train_mean"), F.stddev_pop(auc("train")).alias("train_std"),
        F.avg(auc("held_out")).alias("val_mean"), F.stddev_pop(auc("held_out")).alias("val_std"))


def validation_curves(rows: DataFrame, width: int, models: tuple = MODELS, folds: int = 5) -> DataFrame:
    """RFN-04: model, param, value, train and validation AUC; best: the value of the best validation AUC."""
    spark, fits, points = rows.sparkSession, [], []
    for m in models:
        name, values = CURVES[m]
        staged = name == "n_estimators" and m in ("random_forest", "extra_trees")     # one forest holds all the smaller ones
        for k in range(folds):
            for v in [max(values)] if staged else values:
                points += [(len(fits), int(u) if staged else 0, name, float(u)) for u in (values if staged else [v])]
                fits.append(Fit(m, {name: v}, k, marks=tuple(values) if staged else ()))
    at = spark.createDataFrame(points, "fit int, mark int, param string, value double")
    got = (run(rows, fits, width).join(F.broadcast(at), ["fit", "mark"])
           .join(F.broadcast(described(fits, spark).select("fit", "model")), "fit"))
    auc = lambda held: F.when((F.col("held") == held) & ~F.isnan("auc"), F.col("auc"))
    curve = got.groupBy("model", "param", "value").agg(F.avg(auc("train")).alias("train_auc"), F.avg(auc("held_out")).alias("val_auc"))
    best = curve.groupBy("model").agg(F.max_by("value", F.struct("val_auc", -F.col("value"))).alias("best_value"))
    return curve.join(best, "model")
