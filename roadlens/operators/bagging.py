"""Random forest of tables beyond one task (MDL-04, SEL-05): ``train``'s estimator with the rows dealt once.

pyspark.ml walks all rows through all trees for each level and adds to the statistics of all open nodes of all trees at
once, which outgrow the caches.  Here a task of a barrier stage keeps its share of the binned rows, as many bytes a row as
features, and grows TREES trees at a time: a level's histograms are summed over the tasks (``lab.shared``) and each task
takes the same splits.  The rules are the estimator's: Poisson(1) draws, ceil(sqrt(features)) features for each node
whether or not they vary in it, weighted Gini over at most 32 bins, a least number of drawn rows on both sides, and leaves
of one parent that predict the same become one.  All chance is hashed, so the forest does not depend on the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators import lab
from roadlens.operators import trees as T
from roadlens.operators.forest import NODES

TREES = 6                                # trees whose histograms are summed at once


def counted(parts: list) -> np.ndarray:
    """The parts' sum; a task's counts are sent as int32."""
    out = parts[0].astype(np.int64)
    for p in parts[1:]:
        out += p
    return out


def bagged(spec: T.Spec, codes: np.ndarray, edges: list[np.ndarray], y: np.ndarray, rid: np.ndarray):
    """One tree over this task's rows (see ``trees`` for the steps)."""
    tree, cuts, width, flat = T.Tree(), T.edge_table(edges), codes.shape[1], codes.ravel()
    drawn = T.poisson_weights(spec.seed, rid)
    rows = np.flatnonzero(drawn)
    start, many, cls = rows * width, drawn[rows].astype(np.float64), y[rows] * T.BINS
    local, node, depth = np.zeros(len(rows), np.int64), np.array([1], np.int64), 0
    while True:
        k, at = len(node), np.arange(len(node))
        cand, _ = T.candidates(spec, node, np.ones((k, width), bool))
        base = local * (2 * T.BINS) + cls
        hist = [np.bincount(base + flat.take(start + c.take(local)), many, 2 * T.BINS * k) for c in np.ascontiguousarray(cand.T)]
        hist, = yield [(counted, np.array(hist).astype(np.int32))]
        left0, left1 = hist.reshape(-1, k, 2, T.BINS).cumsum(3).astype(np.float64).transpose(2, 1, 0, 3)
        n0, n1 = left0[:, 0, -1], left1[:, 0, -1]
        gain = T.gains(spec, n0[:, None, None], n1[:, None, None], left0, left1).reshape(k, -1)
        best = T.first_best(gain)
        done = T.may_split(spec, depth, n0, n1) & T.accept(spec, gain[at, best])
        f, code = cand[at, best // T.BINS], best % T.BINS
        tree.add(node, np.where(done, f, -1), np.where(done, cuts[f, code], 0.0), n0, n1)
        if not done.any():
            return tree
        node, depth = np.stack([2 * node[done], 2 * node[done] + 1], 1).ravel(), depth + 1
        if depth == spec.max_depth:                                        # their counts are known
            own = [v.reshape(k, -1)[at, best][done] for v in (left0, left1)]
            n0, n1 = (np.stack([v, whole[done] - v], 1).ravel() for v, whole in zip(own, (n0, n1), strict=True))
            tree.add(node, np.full(len(node), -1), np.zeros(len(node)), n0, n1)
            return tree
        keep = done.take(local)
        start, many, cls, local = start[keep], many[keep], cls[keep], local[keep]
        side = flat.take(start + f.take(local)) > code.take(local)
        local = 2 * (np.cumsum(done) - 1).take(local) + side


def merged(tree: T.Tree, class_weight: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """The tree's arrays (``Tree.arrays``) after two leaves of one parent that predict the same class become one, from the
    lowest level up."""
    node, feature, threshold, n0, n1 = tree.arrays()
    node, feature = node.astype(np.int64), feature.astype(np.int64)
    left, right = T.links(node, feature)
    yes, there = class_weight[1] * n1 > class_weight[0] * n0, np.ones(len(node), bool)
    level = np.frexp(node.astype(np.float64))[1]
    for depth in np.unique(level)[::-1]:
        at = np.flatnonzero((level == depth) & (feature >= 0))
        a, b = left[at], right[at]
        same = (feature[a] < 0) & (feature[b] < 0) & (yes[a] == yes[b])
        feature[at[same]], threshold[at[same]] = -1, 0.0
        there[a[same]] = there[b[same]] = False
    return tuple(v[there] for v in (node, feature, threshold, n0, n1))


def packed_codes(codes: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(codes.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])


def unpacked_codes(column: pa.Array, width: int) -> np.ndarray:
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].reshape(-1, width)


def apart(rid: np.ndarray) -> np.ndarray:
    """Sorted row hashes, those of equal rows told apart: each is drawn by itself."""
    first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]]) if len(rid) else np.zeros(0, np.int64)
    copy = np.arange(len(rid)) - np.repeat(first, np.diff(np.r_[first, len(rid)]))
    with np.errstate(over="ignore"):
        return rid + copy * np.int64(0x9E3779B97F4A7C1)


def fit(rows: DataFrame, width: int, n_trees: int, max_depth: int, min_leaf: int, seed: int, tasks: int | None = None
        ) -> tuple[DataFrame, tuple[float, float]]:
    """Node table (``forest``) and class weights of the forest over ``rows``: id, label, x (array of ``width`` floats)."""
    from roadlens.session import ensure_checkpoint_dir
    folder, cores = ensure_checkpoint_dir(rows.sparkSession), rows.sparkSession.sparkContext.defaultParallelism
    n, n1 = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    weight, edges = lab.balanced(n, n1), lab.bin_edges(rows.withColumn("fold", F.lit(0)).coalesce(cores), width)
    specs = [T.Spec(seed=seed * 100_003 + k, n_candidates=math.ceil(math.sqrt(width)), max_depth=max_depth, min_leaf=min_leaf, extra=False,
                    bootstrap=True, class_weight=weight, total=float(n)) for k in range(n_trees)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed_codes(T.bin_codes(x, edges))], names=["rid", "label", "codes"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint8)]]     # a task without rows takes the steps, too
        for b in batches:
            if b.num_rows:
                own = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), unpacked_codes(b.column(2), width).copy()
                for part, new in zip(parts, own, strict=True):
                    part.append(new)
        rid, y, codes = (np.concatenate(parts.pop(0)) for _ in range(3))
        order = np.argsort(rid, kind="stable")
        rid, y, codes = apart(rid[order]), y[order], codes[order]
        peers = lab.Exchange(folder)
        for turn, first in enumerate(range(0, n_trees, TREES)):
            some = specs[first:first + TREES]
            got = lab.shared(T.together([bagged(s, codes, edges, y, rid) for s in some]), peers)
            for k, tree in enumerate(got if turn % peers.many == peers.me else [], first):
                node, feature, threshold, n0, n1 = merged(tree, weight)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, np.int32)), pa.array(node), pa.array(feature.astype(np.int32)),
                                                  pa.array(threshold), pa.array(n0), pa.array(n1)], names=["tree", "node", "feature", "threshold", "n0", "n1"])
        peers.close()

    tasks = tasks or max(1, min(-(-n // lab.TASK_ROWS), cores))
    shares = (rows.select(F.xxhash64("id", "label", "x").alias("rid"), "label", "x").mapInArrow(coded, "rid long, label int, codes binary")
              .withColumn("g", F.pmod("rid", F.lit(tasks)).cast("int")).repartitionById(tasks, "g").select("rid", "label", "codes"))
    return shares.mapInArrow(grown, NODES, barrier=True).checkpoint(eager=True), weight


def split_trees(nodes: DataFrame) -> DataFrame:
    """The node table without trees that are one leaf: pyspark.ml's importance is a mean over the others."""
    return nodes.join(F.broadcast(nodes.where("node = 1 and feature >= 0").select("tree")), "tree", "left_semi")
