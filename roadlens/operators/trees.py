"""Tree growing on row blocks: the small numpy steps that the model lab runs inside Spark tasks.

A tree is a set of nodes with heap numbers (root 1, children 2 i and 2 i + 1).  All its chance
(candidate features, thresholds, row weights) is a hash of (seed, node, feature) or (seed, row id),
so a tree is the same whoever grows it: one task, or many tasks level by level (``forest``).

The fits are generators (``growing``, ``boosted``, ``solved``): where a step needs sums over all rows they yield
[(merge, this task's array), ...] and are sent the merged arrays, so that tasks with a share of the rows each take the
same steps.  ``alone`` runs one whose rows are all here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

BINS = 32


def total(parts: list) -> np.ndarray:
    """The parts' sum, in their order."""
    return parts[0] if len(parts) == 1 else sum(parts[1:], parts[0])


def least(parts: list) -> np.ndarray:
    return np.minimum.reduce(parts)


def greatest(parts: list) -> np.ndarray:
    return np.maximum.reduce(parts)


def alone(steps):
    """What a fit returns whose rows are all here."""
    got = None
    try:
        while True:
            got = [merge([mine]) for merge, mine in steps.send(got)]
    except StopIteration as end:
        return end.value


def together(fits: list):
    """Several fits side by side: one request for what all of them ask; returns what they return."""
    out, replies = [None] * len(fits), dict.fromkeys(range(len(fits)))
    while replies:
        asked = {}
        for i, reply in replies.items():
            try:
                asked[i] = fits[i].send(reply)
            except StopIteration as end:
                out[i] = end.value
        if not asked:
            break
        got = iter((yield [a for each in asked.values() for a in each]))
        replies = {i: [next(got) for _ in each] for i, each in asked.items()}
    return out


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) that depend on all of ``parts`` (integers or integer arrays)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(32))
            h = h * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def poisson_weights(seed: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is drawn with replacement: Poisson(1) by the row's hash."""
    cdf = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    return np.searchsorted(cdf, uniform(seed, 77, rows)).astype(np.int64)


def bin_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Code c of a value: number of edges below it; code <= b is value <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1).astype(np.uint8)


def edge_table(edges: list[np.ndarray]) -> np.ndarray:
    """(features, BINS): the greatest value of each code (the last code has none)."""
    out = np.zeros((len(edges), BINS))
    for f, e in enumerate(edges):
        out[f, :len(e)] = e
    return out


@dataclass
class Spec:
    """One tree: ``extra`` (one random threshold per candidate feature) or best split over bins."""
    seed: int
    n_candidates: int
    max_depth: int = 62
    min_split: int = 2
    min_leaf: int = 1
    min_decrease: float = 0.0
    extra: bool = True
    bootstrap: bool = False
    entropy: bool = False
    class_weight: tuple[float, float] = (1.0, 1.0)
    total: float = 0.0                       # weighted rows at the root


@dataclass
class Tree:
    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    n0: list = field(default_factory=list)
    n1: list = field(default_factory=list)

    def add(self, node, feature, threshold, n0, n1) -> None:
        for mine, new in zip((self.node, self.feature, self.threshold, self.n0, self.n1), (node, feature, threshold, n0, n1), strict=True):
            mine.append(np.asarray(new))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """node, feature (-1: leaf), threshold, n0, n1 in the order of node."""
        cols = [np.concatenate(c) if c else np.zeros(0) for c in (self.node, self.feature, self.threshold, self.n0, self.n1)]
        order = np.argsort(cols[0], kind="stable")
        return tuple(c[order] for c in cols)


def impurity(a: np.ndarray, b: np.ndarray, entropy: bool) -> np.ndarray:
    """Impurity times weight of two classes' weights."""
    n = np.maximum(a + b, 1e-300)
    if entropy:
        return -(a * np.log2(np.maximum(a, 1e-300) / n) + b * np.log2(np.maximum(b, 1e-300) / n))
    return 2.0 * a * b / n


def gains(spec: Spec, n0, n1, left0, left1) -> np.ndarray:
    """Decrease of weighted impurity of splits; -1 where a side is too small.  All arrays broadcast."""
    w0, w1 = spec.class_weight
    a, b, la, lb = w0 * n0, w1 * n1, w0 * left0, w1 * left1
    gain = impurity(a, b, spec.entropy) - impurity(la, lb, spec.entropy) - impurity(a - la, b - lb, spec.entropy)
    n_left = left0 + left1
    small = np.minimum(n_left, n0 + n1 - n_left) < spec.min_leaf
    return np.where(small, -1.0, gain)


def candidates(spec: Spec, node: np.ndarray, varies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, m) features in hash order among those that vary in the node, and whether each is one."""
    order = np.where(varies, uniform(spec.seed, node[:, None], 1000 + np.arange(varies.shape[1])), 2.0)
    cand = np.argsort(order, axis=1, kind="stable")[:, :spec.n_candidates]
    return cand, np.take_along_axis(varies, cand, 1)


def thresholds(spec: Spec, node: np.ndarray, cand: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One random threshold for each candidate, between the node's least and greatest value (all float32)."""
    t = (lo + uniform(spec.seed, node[:, None], cand) * (hi.astype(np.float64) - lo)).astype(np.float32)
    return np.where(t >= hi, lo, t)


def first_best(gain: np.ndarray) -> np.ndarray:
    """Per row the first place of its greatest gain; gains that differ by rounding only are equal."""
    top = gain.max(1, keepdims=True)
    return (gain >= top - 1e-9 * np.maximum(1.0, np.abs(top))).argmax(1)


def accept(spec: Spec, gain: np.ndarray) -> np.ndarray:
    return (gain > 1e-12) & (gain >= spec.min_decrease * spec.total)


def may_split(spec: Spec, depth: int, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (depth < spec.max_depth) & (n0 + n1 >= spec.min_split) & (n0 > 0) & (n1 > 0)


def grow(spec: Spec, x: np.ndarray, codes: np.ndarray | None, edges, y: np.ndarray, w: np.ndarray, root: int = 1, depth: int = 0) -> Tree:
    """Grows the subtree of ``root`` over rows x (n, features) of class y and weight w, level by level."""
    return alone(growing(spec, x, codes, edges, y, w, root, depth))


SHARED_CELLS = 1 << 17                   # places that are counted at once: they stay in a core's cache
SHARED_LEVELS = 9                        # levels whose nodes are always split by sums over all tasks
SMALL, ROUND = 8_192, 400_000            # rows of a node that one task finishes; rows of such nodes that are sent at once


def finished(spec: Spec, data: np.ndarray, edges, y: np.ndarray, w: np.ndarray, node: np.ndarray, small: np.ndarray, sizes: np.ndarray,
             depth: int, part: tuple[int, int]):
    """The subtrees of the nodes ``small`` (``sizes``: rows of each), each grown by one of the tasks; ``node``: that of each row."""
    out, round_ = [], np.cumsum(sizes) // ROUND
    for r in np.unique(round_):
        sent = np.flatnonzero(np.isin(node, small[round_ == r]))
        got = yield [(list, node[sent]), (list, data[sent]), (list, y[sent]), (list, w[sent])]
        mine = small[round_ == r][part[0]::part[1]]
        keep = [np.flatnonzero(np.isin(at, mine)) for at in got[0]]
        at, rows, cls, many = (np.concatenate([p[k] for p, k in zip(parts, keep, strict=True)]) for parts in got)
        grown = []
        for v in mine:
            here = np.flatnonzero(at == v)
            grown.append(grow(spec, rows[here], rows[here], edges, cls[here], many[here], int(v), depth).arrays())
        nodes = np.concatenate([np.zeros(0, np.int64)] + [g[0] for g in grown]).astype(np.int64)
        rest = np.concatenate([np.zeros((0, 4))] + [np.stack(g[1:], 1).astype(np.float64) for g in grown])
        nodes, rest = yield [(list, nodes), (list, rest)]
        out += list(zip(nodes, rest, strict=True))
    return out


class Held:
    """This task's rows of a level's open nodes, in the order of (node, class); ``many``: their weights, None if all are 1."""

    def __init__(self, columns: np.ndarray, rows: np.ndarray, many: np.ndarray | None, sizes: np.ndarray):
        self.columns, self.rows, self.many, self.sizes = columns, rows, many, sizes        # sizes: (nodes, 2)
        self.each = sizes.sum(1)

    def only(self, nodes: np.ndarray) -> Held:
        """The rows of some of the nodes."""
        if len(nodes) == len(self.sizes):
            return self
        keep = np.zeros(len(self.sizes), bool)
        keep[nodes] = True
        mine = np.flatnonzero(np.repeat(keep, self.each))
        return Held(self.columns, self.rows.take(mine), self.many if self.many is None else self.many.take(mine), self.sizes[nodes])

    def values(self, feature: np.ndarray) -> np.ndarray:
        """Each row's value of its node's feature; of several features (nodes, features) a column for each."""
        rows = self.rows if feature.ndim == 1 else self.rows[:, None]
        return self.columns.ravel().take(np.repeat(feature * self.columns.shape[1], self.each, 0) + rows)

    def pieces(self, slots: np.ndarray) -> list[np.ndarray]:
        """Features (nodes, slots) in pieces that are read at once: all of few rows, one slot of many."""
        return [slots] if len(self.rows) * slots.shape[1] <= GRID else list(np.ascontiguousarray(slots.T))

    def over(self, how, values: np.ndarray, sizes: np.ndarray, empty, kind=None) -> np.ndarray:
        """``how`` (a ufunc) over successive runs of rows."""
        out, there = np.full((sizes.size, *values.shape[1:]), empty, kind or values.dtype), np.flatnonzero(sizes)
        if len(there):
            out[there] = how.reduceat(values, (np.cumsum(sizes) - sizes.ravel())[there], dtype=kind)
        return out

    def range(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.finfo(values.dtype)
        return self.over(np.minimum, values, self.each, ends.max), self.over(np.maximum, values, self.each, ends.min)

    def weight(self, go: np.ndarray) -> np.ndarray:
        """(nodes, 2, columns): weight of the rows ``go`` of each class."""
        if self.many is None:
            got = self.over(np.add, go, self.sizes, 0, np.int64).astype(np.float64)
        else:
            got = self.over(np.add, go * (self.many if go.ndim == 1 else self.many[:, None]), self.sizes, 0)
        return got.reshape(len(self.sizes), 2, -1)

    def counts(self, codes: np.ndarray, cells: int = BINS) -> np.ndarray:
        """(nodes, columns, 2, cells): weight of each class by code."""
        k, m, many = len(self.sizes), 1 if codes.ndim == 1 else codes.shape[1], self.many
        key = np.repeat(np.arange(2 * k) * (m * cells), self.sizes.ravel())
        if codes.ndim > 1:
            key, many = (key[:, None] + (np.arange(m) * cells + codes)).ravel(), many if many is None else np.repeat(many, m)
        else:
            key += codes
        return np.bincount(key, many, 2 * k * m * cells).astype(np.float64, copy=False).reshape(k, 2, m, cells).transpose(0, 2, 1, 3)

    def split(self, left: np.ndarray, open_: np.ndarray) -> Held:
        """The rows of the children that are open ((2, nodes): left, right): all left children first."""
        parts = [side & np.repeat(o, self.each) for side, o in ((left, open_[0]), (~left, open_[1]))]
        sizes = [self.over(np.add, go, self.sizes, 0, np.int64).reshape(-1, 2)[o] for go, o in zip(parts, open_, strict=True)]
        at = np.concatenate([np.flatnonzero(go) for go in parts])
        return Held(self.columns, self.rows.take(at), self.many if self.many is None else self.many.take(at), np.concatenate(sizes))


def joined(bins: list[int], most: int) -> list[tuple[list[int], list[int]]]:
    """Features whose codes are counted as one: (features, how many codes each has), ``most`` places at most."""
    groups = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        for names, sizes in groups:
            if math.prod(sizes) * bins[f] <= most:
                names.append(f)
                sizes.append(bins[f])
                break
        else:
            groups.append(([f], [bins[f]]))
    return groups


CELLS = 1_024                            # places of features that are counted as one
GRID = 1 << 16                           # values that are read at once
PIECE = 1 << 17                          # rows of a boosted tree that are taken at once


class Joint:
    """Codes of several features as one number: counted once, then summed up for each of them."""

    def __init__(self, codes: np.ndarray):
        bins = (codes.max(0).astype(int) + 1).tolist() if len(codes) else [1] * codes.shape[1]
        self.groups = joined(bins, CELLS)
        self.columns = np.empty((len(self.groups), len(codes)), np.int16)
        self.cells = [math.prod(sizes) for _, sizes in self.groups]
        for column, (names, sizes) in zip(self.columns, self.groups, strict=True):
            column[:] = 0
            for f, n in zip(names, sizes, strict=True):
                column *= np.int16(n)
                column += codes[:, f]

    def spread(self, g: int, counted: np.ndarray, out: np.ndarray) -> None:
        """Sums (..., places) of group ``g`` into out (..., features, BINS)."""
        names, sizes = self.groups[g]
        whole, lead = counted.reshape(*counted.shape[:-1], *sizes), counted.ndim - 1
        for i, (f, n) in enumerate(zip(names, sizes, strict=True)):
            out[..., f, :n] = whole.sum(tuple(lead + j for j in range(len(sizes)) if j != i))


def varying(spec: Spec, node: np.ndarray, constant: np.ndarray, tries: int, seen, varies):
    """For each node its features in hash order and whether each varies in it: the first ``tries`` are looked at, the next ones where
    too few of those vary.  ``constant``: features that are known not to vary.  ``seen(nodes, slots)`` asks for what
    ``varies`` tells it by.  Returns (order, whether each is known to vary, [(nodes, places, reply)])."""
    k, width = constant.shape
    order = np.argsort(np.where(constant, 2.0, uniform(spec.seed, node[:, None], 1000 + np.arange(width))), axis=1, kind="stable")
    known, replies = np.zeros((k, width), bool), []
    todo, at = np.arange(k), 0
    while len(todo) and at < width:
        end = min(at + tries, width)
        got = yield from seen(todo, order[todo, at:end])
        some = varies(got)
        known[todo, at:end] = some
        constant[todo[:, None], order[todo, at:end]] |= ~some
        replies.append((todo, slice(at, end), got))
        enough = known[todo].sum(1)
        todo = todo[(enough < min(spec.n_candidates, width)) & ((~constant[todo]).sum(1) > enough)]
        at = end
    return order, known, replies


def placed(replies: list, which: int, k: int, width: int) -> np.ndarray:
    """(nodes, features, ...): one of the replies' arrays by node and place in the order (0 where it was not asked)."""
    if len(replies) == 1:
        return replies[0][2][which]
    out = np.zeros((k, width, *replies[0][2][which].shape[2:]), replies[0][2][which].dtype)
    for nodes, at, got in replies:
        out[nodes, at] = got[which]
    return out


def growing(spec: Spec, x: np.ndarray, codes: np.ndarray | None, edges, y: np.ndarray, w: np.ndarray, root: int = 1, depth: int = 0,
            part: tuple[int, int] | None = None):
    """``grow`` over this task's rows; ``part``: its place among how many tasks.  Of a node only the features that may become
    its candidates are read."""
    tree, table = Tree(), x if spec.extra else codes
    columns, width, cuts = np.ascontiguousarray(table.T), table.shape[1], None if spec.extra else edge_table(edges)
    rows = np.concatenate([np.flatnonzero((w != 0) & (y == c)) for c in (0, 1)])
    many = w[rows].astype(np.float64)
    held = Held(columns, rows, None if (many == 1).all() else many, np.array([[np.count_nonzero(y[rows] == 0), np.count_nonzero(y[rows] == 1)]]))
    counts, = yield [(total, held.weight(np.ones(len(rows), bool))[0, :, 0])]
    n0, n1 = counts[:1], counts[1:]
    node, constant, tries, joint = np.array([root], np.int64), np.zeros((1, width), bool), min(spec.n_candidates, width), None
    open_ = may_split(spec, depth, n0, n1)
    held = held.only(np.flatnonzero(open_))
    while len(node):
        feature, cut, at = np.full(len(node), -1), np.zeros(len(node)), np.flatnonzero(open_)
        if part and depth >= SHARED_LEVELS and spec.max_depth > depth + 2 and (small := n0[at] + n1[at] <= SMALL).any():
            gone, stay = held.only(np.flatnonzero(small)), np.ones(len(node), bool)
            stay[at[small]] = False
            for nodes, rest in (yield from finished(spec, table[gone.rows], edges, y[gone.rows], np.ones(len(gone.rows)) if gone.many is None else gone.many,
                                                    np.repeat(node[at[small]], gone.each), node[at[small]], (n0 + n1)[at[small]], depth, part)):
                tree.add(nodes, rest[:, 0].astype(np.int64), *rest[:, 1:].T)
            held = held.only(np.flatnonzero(~small))
            node, n0, n1, feature, cut, open_ = (a[stay] for a in (node, n0, n1, feature, cut, open_))
            constant, at = constant[~small], np.flatnonzero(open_)
        k, row = len(at), np.arange(len(at))
        if not k:
            tree.add(node, feature, cut, n0, n1)
            break
        total0, total1, first, go = n0[at][:, None], n1[at][:, None], [], []
        if spec.extra:
            def seen(nodes, slots, held=held, first=first, k=k):
                some = held.only(nodes)
                got = [some.values(f) for f in some.pieces(slots)]
                if len(nodes) == k and len(got) > 1:
                    first.extend(got)
                lo, hi = (np.column_stack(each) for each in zip(*map(some.range, got), strict=True))
                return (yield [(least, lo), (greatest, hi)])

            order, known, replies = yield from varying(spec, node[at], constant, tries + (depth > 0), seen, lambda got: got[1] > got[0])
        else:
            if joint is None and tries >= width // 3 and len(rows) > CELLS:
                joint = Joint(codes)

            def seen(nodes, slots, held=held, k=k):
                some = held.only(nodes)
                if joint and len(nodes) * CELLS <= min(SHARED_CELLS, len(some.rows)):
                    every = np.zeros((len(nodes), 2, width, BINS))
                    for g, cells in enumerate(joint.cells):
                        joint.spread(g, some.counts(joint.columns[g].take(some.rows), cells)[:, 0], every)
                    hist = every.transpose(0, 2, 1, 3)[np.arange(len(nodes))[:, None], slots]
                else:
                    hist = np.concatenate([some.counts(some.values(f)) for f in some.pieces(slots)], 1)
                return (yield [(total, hist)])

            order, known, replies = yield from varying(spec, node[at], constant, tries + (depth > 0), seen, lambda got: (got[0].sum(2) > 0).sum(2) > 1)
        pick = np.argsort(~known, axis=1, kind="stable")[:, :tries]
        cand, real = np.take_along_axis(order, pick, 1), np.take_along_axis(known, pick, 1)
        if spec.extra:
            lo, hi = (np.take_along_axis(placed(replies, which, k, width), pick, 1) for which in (0, 1))
            t, left = thresholds(spec, node[at], cand, lo, hi), np.empty((k, tries, 2))
            if first:
                for j in range(tries):
                    v = first[j] if (pick[:, j] == j).all() else held.values(cand[:, j])
                    go.append(v <= np.repeat(t[:, j], held.each))
                    left[:, j] = held.weight(go[-1])[:, :, 0]
            else:
                left = held.weight(held.values(cand) <= np.repeat(t, held.each, 0)).transpose(0, 2, 1)
            left, = yield [(total, left)]
            gain = np.where(real, gains(spec, total0, total1, left[:, :, 0], left[:, :, 1]), -1.0)
            slot = first_best(gain)
            top, v, left = gain[row, slot], t[row, slot], left[row, slot]
        else:
            hist = np.take_along_axis(placed(replies, 0, k, width), pick[:, :, None, None], 1).cumsum(3)
            gain = np.where(real[:, :, None], gains(spec, total0[:, :, None], total1[:, :, None], hist[:, :, 0], hist[:, :, 1]), -1.0)
            gain = gain.reshape(k, -1)
            best = first_best(gain)
            slot, code, top = best // BINS, best % BINS, gain[row, best]
            v, left = cuts[cand[row, slot], code], hist[row, slot, :, code]
        f, done = cand[row, slot], accept(spec, top)
        feature[at[done]], cut[at[done]] = f[done], v[done]
        tree.add(node, feature, cut, n0, n1)
        parent, n0, n1 = node[at[done]], *(np.r_[of_left[done], (whole[at] - of_left)[done]] for of_left, whole in ((left[:, 0], n0), (left[:, 1], n1)))
        node, constant, depth = np.r_[2 * parent, 2 * parent + 1], constant[done], depth + 1
        open_ = may_split(spec, depth, n0, n1)
        to = np.zeros((2, k), bool)
        to[:, done] = open_.reshape(2, -1)
        constant = np.concatenate([constant, constant])[open_]
        if to.any():
            if go:
                n = len(held.rows)
                left = np.concatenate(go).take(np.repeat(slot * n, held.each) + np.arange(n))
            else:
                left = held.values(f) <= np.repeat(v if spec.extra else code.astype(np.uint8), held.each)
            held = held.split(left, to)
    return tree


def links(node: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the left and the right child of each node (its own for leaves)."""
    own = np.arange(len(node))
    left = np.where(feature >= 0, np.searchsorted(node, 2 * node), own)
    right = np.where(feature >= 0, np.searchsorted(node, 2 * node + 1), own)
    return np.minimum(left, len(node) - 1), np.minimum(right, len(node) - 1)


def leaf_of(x: np.ndarray, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Index of the leaf of each row."""
    left, right = links(node, feature)
    at, flat, start = np.zeros(len(x), np.int64), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    asked = np.maximum(feature, 0)                   # a leaf leads to itself
    for _ in range(int(node[-1]).bit_length() - int(node[0]).bit_length()):
        at = np.where(flat.take(start + asked.take(at)) <= threshold.take(at), left.take(at), right.take(at))
    return at


def share(n0: np.ndarray, n1: np.ndarray, class_weight: tuple[float, float]) -> np.ndarray:
    """Weighted share of class 1 in each node."""
    a, b = class_weight[0] * n0, class_weight[1] * n1
    return b / np.maximum(a + b, 1e-300)


# ------------------------------------------------------------------ second-order boosting

@dataclass
class Boost:
    """Gradient boosting on binned rows.  ``shape``: depth (all nodes of a level), leaves (the best
    splits of a level while fewer than num_leaves), symmetric (one split for a whole level)."""
    rounds: int
    rate: float
    max_depth: int = 6
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_child_weight: float = 0.0
    min_leaf: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    level_share: float = 1.0
    num_leaves: int = 1 << 30
    shape: str = "depth"
    variance: bool = False                  # splits by squared error of the gradients (hessian 1), Newton leaves
    positive_weight: float = 1.0
    seed: int = 42


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_weight(p: Boost, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -shrunk(g, p.l1) / np.maximum(h + p.l2, 1e-12)


def histograms(p: Boost, codes: np.ndarray, joint: Joint | None, k: int, pieces, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Sums per (node, feature, bin) over this task's rows of g and h (variance: of g and 1), and of 1 where leaves have a least
    size.  ``pieces``: (rows, node of each)."""
    width, each = codes.shape[1], [g, None] if p.variance else [g, h, None] if p.min_leaf > 1 else [g, h]
    if joint and k * CELLS <= min(SHARED_CELLS, len(codes)):
        sums, out = [[np.zeros(k * cells) for _ in each] for cells in joint.cells], [np.zeros((k, width, BINS)) for _ in each]
        for rows, local in pieces:
            values = [v if v is None else v.take(rows) for v in each]
            for column, cells, mine in zip(joint.columns, joint.cells, sums, strict=True):
                key = column.take(rows) + local * cells
                for v, whole in zip(values, mine, strict=True):
                    whole += np.bincount(key, v, k * cells)
        for i, mine in enumerate(sums):
            for v, whole in zip(mine, out, strict=True):
                joint.spread(i, v.reshape(k, -1), whole)
        return out
    out = [np.zeros(width * k * BINS) for _ in each]
    for rows, local in pieces:
        key = (codes.take(rows, 0) + (local * BINS)[:, None] + np.arange(width) * (k * BINS)).ravel()
        for v, whole in zip(each, out, strict=True):
            whole += np.bincount(key, v if v is None else np.repeat(v.take(rows), width), width * k * BINS)
    return [v.reshape(width, k, BINS).transpose(1, 0, 2) for v in out]


def boost_tree(p: Boost, round_: int, codes: np.ndarray, joint: Joint | None, g: np.ndarray, h: np.ndarray, used: np.ndarray):
    """One tree: list of levels (node, feature, code, G, H) and each row's added value.  Of two siblings the smaller one is
    summed, the other is their parent less it.  With ``joint`` codes a node's own sums come from its parent's histogram, too, and
    rows are taken PIECE at a time."""
    n, width = codes.shape
    pick = lambda share, tag: np.sort(np.argsort(uniform(p.seed, round_, tag, np.arange(width)), kind="stable")
                                      [:max(1, int(round(share * width)))])
    columns, flat, size = pick(p.column_share, 1), codes.ravel(), PIECE if joint else max(n, 1)
    pieces, place = [slice(a, a + size) for a in range(0, n, size)], np.arange(min(n, size)) * width
    gn, hn, cn = yield [(total, np.array([sum(float(v[c][used[c]].sum()) for c in pieces)])) for v in (g, h, used)]
    local, node = np.zeros(n, np.int32), np.array([1], np.int64)          # each row's node among the level's, or its leaf: -1, -2, ...
    ends, levels, leaves, depth = 0, [], 1, 0
    sums, parents = [], np.zeros(0, np.int64)
    score = lambda a, b: shrunk(a, p.l1) ** 2 / np.maximum(b + (0.0 if p.variance else p.l2), 1e-12)

    def mine(only=None):
        """The rows that fit and the node of each: all nodes, or the pairs of those in ``only``."""
        for c in pieces:
            at = local[c].astype(np.intp)                                  # a leaf's place is that of no node
            rows = np.flatnonzero(used[c] & ((at >= 0) if only is None else only.take(at, mode="wrap")))
            yield rows + c.start, at.take(rows) if only is None else at.take(rows) >> 1

    while len(node):
        k, row = len(node), np.arange(len(node))
        feature, cut, cl = np.full(k, -1), np.zeros(k, np.int64), None
        if not joint and depth:
            rows, at = next(mine(), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            gn, hn, cn = yield [(total, np.bincount(at, v if v is None else v[rows], k)) for v in (g, h, None)]
        if depth < p.max_depth and leaves < p.num_leaves:
            cols = columns if p.level_share >= 1 else np.intersect1d(columns, pick(p.level_share, 100 + depth))
            cols = cols if len(cols) else columns[:1]
            if not sums:
                sums = yield [(total, v) for v in histograms(p, codes, joint, 1, mine(), g, h)]
            else:
                weigh = hn if cn is None else cn
                lesser = 2 * np.arange(k // 2) + (weigh[1::2] < weigh[0::2])
                small = np.zeros(k + ends, bool)
                small[lesser] = True
                parts = yield [(total, v) for v in histograms(p, codes, joint, k // 2, mine(small), g, h)]
                above, sums = sums, [np.empty((k, width, BINS)) for _ in parts]
                for part, whole, both in zip(parts, above, sums, strict=True):
                    both[lesser], both[lesser ^ 1] = part, whole[parents] - part
            gl, hl = sums[0][:, cols].cumsum(2), sums[1][:, cols].cumsum(2)
            cl = hl if p.variance else sums[2][:, cols].cumsum(2) if len(sums) > 2 else None
            ht, gt = (cn if p.variance else hn)[:, None, None], gn[:, None, None]
            each = 0.5 * (score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)) - p.min_gain
            light = np.minimum(hl, ht - hl) < max(p.min_child_weight, 1e-12)
            if cl is not None:
                light |= np.minimum(cl, cn[:, None, None] - cl) < p.min_leaf
            each = np.where(light, -np.inf, each)
            if p.shape == "symmetric":
                whole = np.where(np.isfinite(each), each, 0.0).sum(0).ravel()
                best = np.full(k, int(whole.argmax()))
                gain = np.full(k, whole.max())
            else:
                best = each.reshape(k, -1).argmax(1)
                gain = each.reshape(k, -1)[row, best]
            good = gain > 1e-12
            if p.shape == "leaves" and leaves + good.sum() > p.num_leaves:
                order = np.argsort(-np.where(good, gain, -np.inf), kind="stable")
                good = np.zeros(k, bool)
                good[order[:p.num_leaves - leaves]] = True
                good &= gain > 1e-12
            feature[good], cut[good] = cols[best[good] // BINS], best[good] % BINS
            leaves += int(good.sum())
        levels.append([node, feature, cut, gn, hn])
        split = feature >= 0
        parents, to = np.flatnonzero(split), np.empty((k, 2), np.int32)
        to[parents] = np.arange(2 * len(parents)).reshape(-1, 2)
        to[~split] = -1 - ends - np.arange(k - len(parents))[:, None]
        asked = np.maximum(feature, 0)
        for c in pieces:
            at, here = local[c].astype(np.intp), flat[c.start * width:]
            rows = np.flatnonzero(at >= 0) if ends else None               # None: all of them
            if rows is not None:
                at = at.take(rows)
            f = asked.take(at)
            f += place[:len(at)] if rows is None else place.take(rows)
            side = here.take(f) > cut.take(at)
            at += at
            at += side
            if rows is None:
                local[c] = to.ravel().take(at)
            else:
                local[c][rows] = to.ravel().take(at)
        ends += k - len(parents)
        if not len(parents):
            break
        both = lambda of_left, whole: np.stack([of_left, whole[parents] - of_left], 1).ravel()
        at_best = lambda v: v.reshape(k, -1)[parents, best[parents]]
        gn, hn, cn = both(at_best(gl), gn), both(at_best(hl), hn), None if cl is None else both(at_best(cl), cn)
        node, depth = np.stack([2 * node[split], 2 * node[split] + 1], 1).ravel(), depth + 1
    if p.variance and joint:                                               # its histograms have no hessians
        whole, = yield [(total, sum((np.bincount(-1 - local[c][used[c]], h[c][used[c]], ends) for c in pieces), np.zeros(ends)))]
        below, at = np.zeros(0), ends
        for level in reversed(levels):
            end = level[1] < 0
            at -= int(end.sum())
            level[4] = np.empty(len(end))
            level[4][end], level[4][~end] = whole[at:at + int(end.sum())], below.reshape(-1, 2).sum(1)
            below = level[4]
    value = np.concatenate([p.rate * leaf_weight(p, gn, hn)[feature < 0] for _, feature, _, gn, hn in levels])
    return [tuple(level) for level in levels], (value, local)


def boost(p: Boost, codes: np.ndarray, y: np.ndarray, train: np.ndarray, rows: np.ndarray, w: np.ndarray | None = None,
          marks: tuple = (), keep: bool = False):
    """Margins of all rows after the rounds; ``train`` rows fit.  Also the margins at the rounds ``marks``
    and, with ``keep``, the trees."""
    return alone(boosted(p, codes, y, train, rows, w, marks, keep))


def boosted(p: Boost, codes: np.ndarray, y: np.ndarray, train: np.ndarray, rows: np.ndarray, w: np.ndarray | None = None,
            marks: tuple = (), keep: bool = False, part: tuple[int, int] | None = None):
    """``boost`` over this task's rows; ``part``: its place among how many tasks."""
    size = PIECE if part else max(len(y), 1)
    pieces = [slice(a, a + size) for a in range(0, len(y), size)]
    weigh = lambda c: np.where(y[c] == 1, p.positive_weight, 1.0) if w is None else w[c]
    w1, whole = yield [(total, sum(float(v.sum()) for v in vs)) for vs in zip(*((
        (weigh(c) * y[c])[train[c]], weigh(c)[train[c]]) for c in pieces), strict=True)] if pieces else [(total, 0.0), (total, 0.0)]
    share1 = float(w1 / max(whole, 1e-300))
    codes = np.ascontiguousarray(codes)
    joint = Joint(codes) if part else None
    margin = np.full(len(y), np.log(max(share1, 1e-9) / max(1 - share1, 1e-9)))
    start, at, trees = float(margin[0]) if len(margin) else 0.0, {}, []
    g, h, used = np.empty(len(y)), np.empty(len(y)), np.asarray(train)
    for t in range(p.rounds):
        if p.row_share < 1:
            used = np.empty(len(y), bool)
        for c in pieces:
            prob, weight = 1.0 / (1.0 + np.exp(-margin[c])), weigh(c)
            g[c], h[c] = weight * (prob - y[c]), weight * np.maximum(prob * (1 - prob), 1e-16)
            if p.row_share < 1:
                used[c] = train[c] & (uniform(p.seed, t, 5, rows[c]) < p.row_share)
        levels, (value, leaf) = yield from boost_tree(p, t, codes, joint, g, h, used)
        for c in pieces:
            margin[c] += value.take(-1 - leaf[c])
        if keep:
            trees.append(levels)
        if t + 1 in marks:
            at[t + 1] = margin.copy()
    return margin, at, start, trees


# ------------------------------------------------------------------ logistic regression

def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, l1_ratio: float = 0.0, steps: int = 500
             ) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on standardised x, penalty / c: accelerated proximal steps.  The
    intercept is not penalised.  Returns coefficients and intercept."""
    return alone(solved(x, y, w, c, l1_ratio, steps))


def solved(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, l1_ratio: float = 0.0, steps: int = 500):
    """``logistic`` over this task's rows."""
    n, width = x.shape
    a = np.c_[x, np.ones(n)]
    gram, whole = yield [(total, (a * w[:, None]).T @ a), (total, w.sum())]
    whole = float(whole)
    lipschitz = 0.25 * np.linalg.eigvalsh(gram / whole)[-1] + 1e-12
    pull, push = (1 - l1_ratio) / (c * whole), l1_ratio / (c * whole)
    lipschitz += pull
    b, z, t = np.zeros(width + 1), np.zeros(width + 1), 1.0
    for _ in range(steps):
        prob = 1.0 / (1.0 + np.exp(-(a @ z)))
        grad, = yield [(total, a.T @ (w * (prob - y)))]
        grad = grad / whole
        grad[:-1] += pull * z[:-1]
        new = z - grad / lipschitz
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - push / lipschitz, 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / t_new * (new - b), np.abs(new - b).max()
        b, t = new, t_new
        if moved < 1e-7:
            break
    return b[:-1], float(b[-1])


def least_quadratic(g: np.ndarray, hess: np.ndarray, b: np.ndarray, pull: float, push: float) -> np.ndarray:
    """The u that minimises g (u - b) + (u - b) hess (u - b) / 2 + penalty of u but its last place: the places
    that are not 0 and their signs are searched, each time with the least of their quadratic."""
    free = np.r_[np.ones(len(b) - 1), 0.0]
    if push == 0:
        return np.linalg.lstsq(hess + np.diag(pull * free), hess @ b - g, rcond=None)[0]
    a, c = hess + np.diag(pull * free), hess @ b - g
    a += np.diag(np.full(len(b), 1e-12 * max(np.trace(a) / len(b), 1e-300)))         # columns that are sums of others
    cost = lambda v: v @ (0.5 * (a @ v) - c) + push * np.abs(v[:-1]).sum()
    u, near = b.copy(), 1e-9 * max(push, float(np.abs(c).max()))
    sign = np.sign(u) * free
    for _ in range(50 * len(u)):
        slope = a @ u - c
        off = (u == 0) & (free > 0)
        wrong = np.where(off, 0.0, np.abs(slope + push * sign))
        if wrong.max() <= near:                                           # the places in use are at their best: use one more
            j = int(np.where(off, np.abs(slope), -1.0).argmax())
            if not off[j] or abs(slope[j]) <= push + near:
                break
            off[j], sign[j] = False, -np.sign(slope[j])
        on = np.flatnonzero(~off)
        new = np.zeros(len(u))
        new[on] = np.linalg.solve(a[np.ix_(on, on)], (c - push * sign)[on])
        crosses = np.flatnonzero((u * new < 0) & (free > 0))
        at = np.r_[1.0, u[crosses] / (u - new)[crosses]]                   # as far as the least cost, which lies where a sign turns or at the end
        tried = [u + t * (new - u) for t in at]
        for v, j in zip(tried[1:], crosses, strict=True):
            v[j] = 0.0
        u = min(tried, key=cost)
        sign = np.sign(u) * free
    return u


def solved_in_few(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, l1_ratio: float = 0.0, steps: int = 500):
    """``solved`` by proximal Newton steps: the same least penalised loss in some ten passes over the rows."""
    n, width = x.shape
    a = np.c_[x, np.ones(n)]
    whole, = yield [(total, w.sum())]
    pull, push = (1 - l1_ratio) / (c * float(whole)), l1_ratio / (c * float(whole))
    b = z = np.zeros(width + 1)
    last = np.inf
    for _ in range(steps):
        eta = a @ z
        prob = 1.0 / (1.0 + np.exp(-eta))
        loss, grad, hess = yield [(total, (w * (np.logaddexp(0.0, eta) - y * eta)).sum()), (total, a.T @ (w * (prob - y))),
                                  (total, (a * (w * prob * (1 - prob))[:, None]).T @ a)]
        now = float(loss / whole + pull / 2 * (z[:-1] ** 2).sum() + push * np.abs(z[:-1]).sum())
        if now > last + 1e-13 and np.abs(z - b).max() > 1e-7:
            z = (b + z) / 2
            continue
        b, last = z, now
        z = least_quadratic(grad / whole, hess / whole, b, pull, push)
        if np.abs(z - b).max() < 1e-7:
            b = z
            break
    return b[:-1], float(b[-1])


# ------------------------------------------------------------------ metrics

def metrics(y: np.ndarray, prob: np.ndarray) -> dict[str, float]:
    """auc (ties by half), f1, recall, precision, accuracy at 0.5 and the confusion counts."""
    pred = prob >= 0.5
    tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
    fn, tn = int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum())
    values, which, many = np.unique(prob, return_inverse=True, return_counts=True)
    rank = np.cumsum(many) - (many - 1) / 2.0
    pos, neg = tp + fn, fp + tn
    auc = float((rank[which][y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / pos if pos else 0.0
    return {"auc": auc, "f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0, "recall": recall, "precision": precision,
            "accuracy": (tp + tn) / max(len(y), 1), "tn": tn, "fp": fp, "fn": fn, "tp": tp}
