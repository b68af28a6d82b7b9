"""The model lab's own learners against brute force: trees, boosting, SHAP, permutations, searches."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import explain as xp
from roadlens.operators import forest, lab
from roadlens.operators import trees as T

WIDTH = 4


def data(n: int = 900, seed: int = 3):
    r = np.random.default_rng(seed)
    x = np.c_[r.normal(size=n), r.integers(0, 2, n), r.integers(0, 9, n), np.full(n, 7.0)].astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=n) > 0.8).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    return spark.createDataFrame([(i, int(y[i]), -1 if i % 6 == 5 else i % 6, [float(v) for v in x[i]]) for i in range(len(y))],
                                 "id long, label int, fold int, x array<float>").repartition(3).cache()


def brute_extra_tree(spec: T.Spec, x, y, node: int = 1, depth: int = 0) -> list[tuple]:
    """One random threshold per candidate feature between the node's least and greatest value; best Gini."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    leaf = [(node, -1, 0.0, float(n0), float(n1))]
    if depth >= spec.max_depth or n0 + n1 < spec.min_split or not n0 or not n1:
        return leaf
    varying = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()]
    varying.sort(key=lambda f: float(T.uniform(spec.seed, node, 1000 + f)))
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    w0, w1 = spec.class_weight
    found = []
    for f in varying[:spec.n_candidates]:
        lo, hi = x[:, f].min(), x[:, f].max()
        t = np.float32(float(lo) + float(T.uniform(spec.seed, node, f)) * (float(hi) - float(lo)))
        t = lo if t >= hi else t
        go = x[:, f] <= t
        if min(go.sum(), (~go).sum()) < spec.min_leaf:
            continue
        la, lb = w0 * (go & (y == 0)).sum(), w1 * (go & (y == 1)).sum()
        gain = gini(w0 * n0, w1 * n1) - gini(la, lb) - gini(w0 * n0 - la, w1 * n1 - lb)
        found.append((gain, f, t, go))
    top = max((g[0] for g in found), default=0.0)
    if top <= 1e-12 or top < spec.min_decrease * spec.total:
        return leaf
    _, f, t, go = next(g for g in found if g[0] >= top - 1e-9 * max(1.0, top))
    return ([(node, f, float(t), float(n0), float(n1))] + brute_extra_tree(spec, x[go], y[go], 2 * node, depth + 1)
            + brute_extra_tree(spec, x[~go], y[~go], 2 * node + 1, depth + 1))


SPECS = [T.Spec(seed=s, n_candidates=m, max_depth=d, min_leaf=leaf, class_weight=(0.7, 1.9), total=750.0)
         for s, (m, d, leaf) in enumerate(itertools.product((2, 4), (3, 9), (1, 6)))]


@pytest.mark.parametrize("small", [40, 300, 50_000])
def test_extra_trees_equal_brute_force(spark, rows, small):
    """Wherever a subtree is grown: level by level over all rows, or in one task."""
    train = rows.where("fold >= 0")
    local = sorted(((r.x, r.label) for r in train.collect()), key=repr)
    x, y = np.array([a for a, _ in local], np.float32), np.array([b for _, b in local])
    got = {}
    for r in forest.grow(train, SPECS, WIDTH, small).collect():
        got.setdefault(r.tree, []).append(tuple(r)[1:])
    for t, spec in enumerate(SPECS):
        assert sorted(got[t]) == sorted(brute_extra_tree(spec, x, y))
    with pytest.raises(ValueError):
        forest.grow(train, [T.Spec(seed=1, n_candidates=1)], WIDTH)


def test_large_tables_move_no_rows(spark, rows, monkeypatch):
    """Above the last levels no row is sent to another task, below them small nodes are; the trees are the same."""
    train, calls = rows.where("fold >= 0"), []
    want = sorted(map(tuple, forest.grow(train, SPECS, WIDTH, 50_000).collect()))
    kept = forest._finish
    monkeypatch.setattr(forest, "_finish", lambda *a: calls.append(a[-1]) or kept(*a))
    monkeypatch.setattr(forest, "PART_ROWS", 100)
    assert sorted(map(tuple, forest.grow(train, SPECS, WIDTH, 300).collect())) == want and calls == []
    monkeypatch.setattr(forest, "LEVELS", 2)
    assert sorted(map(tuple, forest.grow(train, SPECS, WIDTH, 300).collect())) == want and min(calls) == 2


def test_forest_scores_and_edges(spark, rows):
    nodes, weight = forest.fit(rows, WIDTH, {"n_estimators": 12, "max_depth": 4})
    test = rows.where(f"fold = {lab.TEST}")
    model = forest.model_arrays(nodes)
    want = {}
    for r in test.collect():
        x = np.array([r.x], np.float32)
        want[r.id] = np.mean([T.share(n0, n1, weight)[T.leaf_of(x, node, f, t)[0]] for node, f, t, n0, n1 in model.values()])
    whole = {r.id: r.score for r in forest.score(test, nodes, weight, WIDTH).collect()}
    assert whole == pytest.approx(want)
    old, forest.SCORE_BYTES = forest.SCORE_BYTES, 1
    try:
        assert {r.id: r.score for r in forest.score(test, nodes, weight, WIDTH).collect()} == pytest.approx(want)
    finally:
        forest.SCORE_BYTES = old
    one_class = rows.withColumn("label", F.lit(0))
    assert [tuple(r)[1:3] for r in forest.fit(one_class, WIDTH, {"n_estimators": 1})[0].collect()] == [(1, -1)]


def brute_best_split(spec, codes, edges, y, w, node=1, depth=0):
    n1, n0 = int((w * y).sum()), int((w * (1 - y)).sum())
    if depth >= spec.max_depth or n0 + n1 < spec.min_split or not n0 or not n1:
        return [(node, -1, 0.0)]
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    best = None
    for f in range(codes.shape[1]):
        for b in range(len(edges[f])):
            go = codes[:, f] <= b
            left, left1 = int(w[go].sum()), int((w * y)[go].sum())
            if min(left, n0 + n1 - left) < spec.min_leaf:
                continue
            gain = gini(n0, n1) - gini(left - left1, left1) - gini(n0 - left + left1, n1 - left1)
            if best is None or gain > best + 1e-9:
                best = gain
    if best is None or best <= 1e-12:
        return [(node, -1, 0.0)]
    return [(node, None, best)]


def test_best_split_takes_the_greatest_gain():
    x, y = data(400)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, T.BINS) / T.BINS)).astype(np.float32) for f in range(WIDTH)]
    codes, w = T.bin_codes(x, edges), T.poisson_weights(5, np.arange(400))
    assert abs(w.mean() - 1) < 0.2 and w.max() < 9
    spec = T.Spec(seed=1, n_candidates=WIDTH, max_depth=1, min_leaf=5, extra=False)
    node, feature, threshold, n0, n1 = T.grow(spec, x, codes, edges, y, w).arrays()
    _, _, best = brute_best_split(spec, codes, edges, y, w)[0]
    gini = lambda a, b: 2 * a * b / (a + b)
    assert gini(n0[0], n1[0]) - gini(n0[1], n1[1]) - gini(n0[2], n1[2]) == pytest.approx(best)
    go = x[:, feature[0]] <= threshold[0]
    assert (int((w * y)[go].sum()), int(w[~go].sum())) == (n1[1], n0[2] + n1[2])


def brute_boost(p: T.Boost, codes, y, rounds):
    """Depth-wise second-order boosting, node by node, without histograms."""
    pos = p.positive_weight
    w = np.where(y == 1, pos, 1.0)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(y), math.log(share / (1 - share)))
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0.0), g)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)
        step = np.zeros(len(y))

        def node(rows, depth, g=g, h=h, step=step):
            gs, hs = g[rows].sum(), h[rows].sum()
            best, at = 1e-12, None
            if depth < p.max_depth:
                for f in range(codes.shape[1]):
                    for b in range(T.BINS):
                        left = rows[codes[rows, f] <= b]
                        if not len(left) or len(left) == len(rows):
                            continue
                        gl, hl = g[left].sum(), h[left].sum()
                        if min(hl, hs - hl) < p.min_child_weight:
                            continue
                        gain = 0.5 * (soft(gl) ** 2 / (hl + p.l2) + soft(gs - gl) ** 2 / (hs - hl + p.l2) - soft(gs) ** 2 / (hs + p.l2)) - p.min_gain
                        if gain > best + 1e-9:
                            best, at = gain, (f, b)
            if at is None:
                step[rows] = -p.rate * soft(gs) / (hs + p.l2)
            else:
                go = codes[rows, at[0]] <= at[1]
                node(rows[go], depth + 1)
                node(rows[~go], depth + 1)

        node(np.arange(len(y)), 0)
        margin = margin + step
    return margin


@pytest.mark.parametrize("more", [{}, {"l1": 0.5, "l2": 2.0, "min_gain": 0.3}, {"min_child_weight": 6.0, "positive_weight": 4.0}])
def test_boosting_equals_brute_force(more):
    x, y = data(250)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 12) / 12)).astype(np.float32) for f in range(WIDTH)]
    codes = T.bin_codes(x, edges)
    p = T.Boost(**({"rounds": 4, "rate": 0.3, "max_depth": 3, "l2": 1.0} | more))
    got, marks, _, _ = T.boost(p, codes, y, np.ones(250, bool), np.arange(250), marks=(2,))
    assert got == pytest.approx(brute_boost(p, codes, y, 4), abs=1e-6)
    assert marks[2] == pytest.approx(brute_boost(p, codes, y, 2), abs=1e-6)


@pytest.mark.parametrize("shape", ["depth", "leaves", "symmetric"])
def test_boosting_lowers_the_loss(shape):
    x, y = data(600)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, T.BINS) / T.BINS)).astype(np.float32) for f in range(WIDTH)]
    loss = lambda m: float(np.mean(np.log1p(np.exp(-np.where(y == 1, m, -m)))))
    p = T.Boost(rounds=30, rate=0.1, max_depth=4, shape=shape, num_leaves=6, variance=shape == "depth")
    end, marks, start, trees = T.boost(p, T.bin_codes(x, edges), y, np.ones(600, bool), np.arange(600), marks=(5, 15), keep=True)
    losses = [loss(np.full(600, start)), loss(marks[5]), loss(marks[15]), loss(end)]
    assert losses == sorted(losses, reverse=True)
    if shape == "leaves":
        assert all(sum((level[1] < 0).sum() for level in tree) <= 6 for tree in trees)
    if shape == "symmetric":
        assert all(len(set(level[1][level[1] >= 0])) <= 1 for tree in trees for level in tree)


def test_logistic_regression_is_optimal():
    x, y = data(500)
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    w = np.where(y == 1, 2.0, 1.0)
    b, a = T.logistic(z.astype(float), y, w, c=0.5, steps=4000)
    prob = 1 / (1 + np.exp(-(z @ b + a)))
    assert np.abs(0.5 * z.T @ (w * (prob - y)) + b).max() < 1e-2 and abs((w * (prob - y)).sum()) < 1e-2
    assert (np.abs(T.logistic(z.astype(float), y, w, c=0.004, l1_ratio=1.0, steps=3000)[0]) < 1e-9).any()


def test_tree_shap_equals_brute_force(spark, rows):
    nodes, weight = forest.fit(rows, WIDTH, {"n_estimators": 5, "max_depth": 5, "max_features": None})
    some = rows.where("id in (5, 11, 17, 23)")
    model, base = forest.model_arrays(nodes), xp.forest_base(nodes, weight)
    got = {(r.id, r.feature): r.shap for r in xp.tree_shap(some, nodes, weight, list("abcd")).collect()}
    score = {r.id: r.score for r in forest.score(some, nodes, weight, WIDTH).collect()}

    def value(x, known, m):
        node, feature, threshold, n0, n1 = m
        cover, left, right = weight[0] * n0 + weight[1] * n1, *T.links(m[0], m[1])
        def go(i):
            if feature[i] < 0:
                return T.share(n0, n1, weight)[i]
            if feature[i] in known:
                return go(left[i] if x[feature[i]] <= threshold[i] else right[i])
            return (cover[left[i]] * go(left[i]) + cover[right[i]] * go(right[i])) / cover[i]
        return go(0)

    for r in some.collect():
        x = np.array(r.x, np.float32)
        v = {s: np.mean([value(x, s, m) for m in model.values()]) for k in range(WIDTH + 1) for s in itertools.combinations(range(WIDTH), k)}
        for f in range(WIDTH):
            want = sum(math.factorial(len(s)) * math.factorial(WIDTH - 1 - len(s)) / math.factorial(WIDTH)
                       * (v[tuple(sorted((*s, f)))] - v[s]) for s in v if f not in s)
            assert got[(r.id, "abcd"[f])] == pytest.approx(want, abs=1e-9)
        assert base + sum(got[(r.id, f)] for f in "abcd") == pytest.approx(score[r.id])


def test_forest_importance_sums_to_one(spark, rows):
    nodes, weight = forest.fit(rows, WIDTH, {"n_estimators": 7, "max_depth": 4})
    got = {r.feature: r.importance for r in xp.forest_importance(nodes, weight, list("abcd")).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["d"] == 0.0 and max(got, key=got.get) == "a"


def test_permutations_equal_the_loop(spark, rows):
    test = rows.where(f"fold = {lab.TEST}")
    predict = lambda x: 1 / (1 + np.exp(-(x[:, 0] + 0.2 * x[:, 2])))
    got = {r.feature: (r.perm_mean, r.perm_std) for r in xp.permutation_importance(test, predict, list("abcd"), repeats=3, keep=True).collect()}
    by = {}
    for r in xp.permuted_rows(test, 3).collect():
        by.setdefault(r.rep, []).append((r.label, r.x, r.other))
    n = test.count()
    assert all(len(v) == n and sorted(map(repr, (a[1] for a in v))) == sorted(map(repr, (a[2] for a in v))) for v in by.values())
    for f, name in enumerate("abcd"):
        drops = []
        for v in by.values():
            y, x, other = np.array([a[0] for a in v]), np.array([a[1] for a in v], np.float32), np.array([a[2] for a in v], np.float32)
            changed = x.copy()
            changed[:, f] = other[:, f]
            drops.append(T.metrics(y, predict(x))["auc"] - T.metrics(y, predict(changed))["auc"])
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)
    assert got["b"] == (0.0, 0.0)


def test_metrics_agree_with_spark(spark, rows):
    from roadlens.operators import evaluate as ev
    x, y = data()
    prob = np.round(1 / (1 + np.exp(-x[:, 0])), 1)
    df = spark.createDataFrame([(i, int(y[i]), float(prob[i]), int(prob[i] >= 0.5)) for i in range(len(y))], "id long, label int, score double, pred int")
    m, c = T.metrics(y, prob), ev.confusion_metrics(df).first()
    assert m["auc"] == pytest.approx(ev.auc(df).first()["auc"])
    assert [m[k] for k in ("tn", "fp", "fn", "tp")] == [c[k] for k in ("tn", "fp", "fn", "tp")] and m["f1"] == pytest.approx(c["f1"])
    g = xp.grouped_auc(df.withColumn("g", F.lit(1)), ["g"]).first()["auc"]
    assert g == pytest.approx(m["auc"])
    assert xp.grouped_auc(df.withColumn("g", F.lit(1)).where("label = 1"), ["g"]).first()["auc"] is None


def test_draws_and_grids():
    for name, space in lab.SPACES.items():
        drawn = lab.draw(space, 60)
        assert len({json.dumps(d, sort_keys=True) for d in drawn}) == 60 and drawn == lab.draw(space, 60)
        for d in drawn:
            assert set(d) == set(space)
            for k, v in d.items():
                assert v in space[k] if isinstance(space[k], list) else space[k][1] <= v <= space[k][2]
        around = lab.focused(drawn[0], lab.GRIDS[name])
        assert len({json.dumps(d, sort_keys=True) for d in around}) == len(around) and all(set(d) == set(drawn[0]) for d in around)
    assert [d["max_depth"] for d in lab.focused({"max_depth": 8, "z": 1.5}, {"max_depth": [5, 8, 10, 12]})] == [7, 8, 9]
    assert [d["c"] for d in lab.focused({"c": 0.5}, {"c": [0.0, 1.0]})] == [0.25, 0.5, 0.75]
    assert [d["m"] for d in lab.focused({"m": "log2"}, {"m": ["sqrt", "log2", None]})] == ["sqrt", "log2", None]


def test_search_counts_and_picks(spark, rows):
    found = lab.search(rows, WIDTH, ("logistic_regression", "decision_tree"), n_draws=4, folds=3)
    got = found.collect()
    drawn = [r for r in got if r.search == "random"]
    assert len(drawn) == 2 * 4 * 3 and {r.objective for r in got} == set(lab.OBJECTIVES)
    r = next(r for r in drawn if r.model == "decision_tree" and r.objective == "auc")
    again = lab.run(rows, [lab.Fit("decision_tree", json.loads(r.params), k) for k in range(3)], WIDTH).where("held = 'held_out'").agg(F.avg("auc")).first()[0]
    assert r.cv_score == pytest.approx(again)


def test_fits_on_tables_beyond_one_task(spark, rows, monkeypatch):
    """The other way for large tables gives the same kind of result for every model."""
    monkeypatch.setattr(lab, "TASK_ROWS", 10)
    small = {"random_forest": {"n_estimators": 3, "max_depth": 3}, "extra_trees": {"n_estimators": 3, "max_depth": 3},
             "newton_boosting": {"n_estimators": 2, "max_depth": 2}}
    fits = [lab.Fit(m, small.get(m, {}), 0) for m in ("logistic_regression", "decision_tree", *small)]
    got = {r.fit: r for r in lab.run(rows, fits, WIDTH).collect()}
    n = rows.where("fold = 0").count()
    assert len(got) == len(fits) and all(r.tn + r.fp + r.fn + r.tp == n and r.auc > 0.6 for r in got.values())


def test_curves(spark, rows):
    models = ("logistic_regression", "decision_tree")
    g = lab.learning_curves(rows, WIDTH, models, folds=2, points=3).collect()
    assert {(r.model, round(r.fraction, 2)) for r in g} == {(m, f) for m in models for f in (0.33, 0.67, 1.0)}
    v = lab.validation_curves(rows, WIDTH, ("decision_tree",), folds=2).collect()
    assert [r.value for r in sorted(v, key=lambda r: r.value)] == [2, 3, 4, 5, 6, 8, 10, 12]
    assert max(v, key=lambda r: (r.val_auc, -r.value)).value == v[0].best_value
    staged = lab.validation_curves(rows, WIDTH, ("extra_trees",), folds=1)
    alone = lab.run(rows, [lab.Fit("extra_trees", {"n_estimators": 50}, 0)], WIDTH).where("held = 'held_out'").first()
    assert staged.where("value = 50").first()["val_auc"] == pytest.approx(alone.auc)


SHARED = [lab.Fit("logistic_regression", {"C": 0.5}, 0), lab.Fit("decision_tree", {"max_depth": 5}, 1),
          lab.Fit("random_forest", {"n_estimators": 5, "max_depth": 4}, 0, 0.7, (2,)), lab.Fit("extra_trees", {"n_estimators": 5, "max_depth": 4}, lab.TEST),
          lab.Fit("newton_boosting", {"n_estimators": 4, "max_depth": 3, "colsample_bylevel": 0.7}, 2), lab.Fit("leafwise_boosting", {"n_estimators": 4}, 0),
          lab.Fit("symmetric_boosting", {"n_estimators": 4}, 0), lab.Fit("gradient_boosting", {"n_estimators": 4}, 0)]


def test_shared_fits_equal_those_of_one_task(spark, rows, monkeypatch):
    """Rows dealt over the tasks of a barrier stage: every model's metrics of both sides, its marks and its scores."""
    key, cols = lambda r: (r.fit, r.mark, r.held), lab.NAMES
    one = {key(r): r for r in lab.run(rows, SHARED, WIDTH).collect()}
    alone = [{r.id: r.score for r in lab.predictions(rows, f, WIDTH).collect()} for f in SHARED]
    monkeypatch.setattr(lab, "TASK_ROWS", 300)
    got = {key(r): r for r in lab.run(rows, SHARED, WIDTH).collect()}
    assert got.keys() == one.keys()
    for k, r in got.items():
        assert [r[c] for c in cols] == pytest.approx([one[k][c] for c in cols], abs=1e-4), k
    for f, want in zip(SHARED[4:6], alone[4:6], strict=True):
        assert {r.id: r.score for r in lab.predictions(rows, f, WIDTH).collect()} == pytest.approx(want, abs=1e-6)


def test_shared_scores_keep_repeated_and_null_ids(spark, monkeypatch):
    """Every held-out row has one score, also where ids repeat or are null; tasks without rows take the steps."""
    monkeypatch.setattr(lab, "TASK_ROWS", 5)
    df = spark.createDataFrame([(None if i % 7 == 0 else i // 2, i % 2, i % 3 - 1, [float(i % 2), float(i)]) for i in range(24)],
                               "id long, label int, fold int, x array<float>")
    got = lab.predictions(df, lab.Fit("newton_boosting", {"n_estimators": 2}), 2).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r.id) for r in df.where("fold = -1").collect())


def test_newton_steps_reach_the_same_coefficients():
    x, y = data(500)
    z, w = ((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)).astype(float), np.where(y == 1, 1.7, 0.6)
    z = np.c_[z, z[:, 0] * 0.5 + z[:, 1]]                               # one column is a sum of others
    for c, ratio in ((0.5, 0.0), (0.004, 1.0), (0.02, 0.4), (100.0, 0.5)):
        b, a = T.logistic(z, y, w, c, ratio, 20_000)
        got, at = T.alone(T.solved_in_few(z, y, w, c, ratio, 100))
        assert z @ got + at == pytest.approx(z @ b + a, abs=2e-4)


@pytest.mark.parametrize("extra", [True, False])
def test_small_nodes_are_finished_by_one_task(extra, monkeypatch):
    """Deep trees over rows in three parts, one of them empty: small nodes are sent to one part, in several rounds."""
    for name, value in (("SHARED_LEVELS", 2), ("SMALL", 120), ("ROUND", 100)):
        monkeypatch.setattr(T, name, value)
    x, y = data()
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 32) / 32).astype(np.float32)) for f in range(WIDTH)]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    codes, w = T.bin_codes(x, edges), np.arange(len(y)) % 3
    spec = T.Spec(seed=5, n_candidates=3, max_depth=14, min_leaf=2, extra=extra, total=float(w.sum()))
    where = np.arange(len(y)) % 2
    parts = [T.growing(spec, x[where == k], codes[where == k], edges, y[where == k], w[where == k], part=(k, 3)) for k in range(3)]
    trees, replies = [], [None] * 3
    while not trees:
        asked = []
        for part, reply in zip(parts, replies, strict=True):
            try:
                asked.append(part.send(reply))
            except StopIteration as end:
                trees.append(end.value.arrays())
        if asked:
            replies = [[asked[0][i][0]([p[i][1] for p in asked]) for i in range(len(asked[0]))] for _ in asked]
    want = T.grow(spec, x, codes, edges, y, w).arrays()
    assert len(trees) == 3 and len(want[0]) > 100
    for tree in trees:
        for got, a in zip(tree, want, strict=True):
            assert got == pytest.approx(a)


def test_learning_curves_have_all_models(spark, rows, monkeypatch):
    """rfn_03 fits every model at ten shares of the training rows in each fold."""
    from roadlens.plans import q_ml
    asked, schema = [], "fit int, mark int, held string, " + ", ".join(f"{n} double" for n in lab.NAMES)

    def run(rows, fits, width):
        asked.extend((f.model, f.fold, f.share) for f in fits)
        return rows.sparkSession.createDataFrame([(i, 0, held, *[0.5] * 9) for i in range(len(fits)) for held in ("held_out", "train")], schema)

    monkeypatch.setattr(q_ml, "lab_rows", lambda *a: rows)
    monkeypatch.setattr(lab, "run", run)
    got = q_ml.rfn_03(spark, "").collect()
    assert sorted(asked) == sorted((m, k, s / 10) for m in lab.MODELS for k in range(5) for s in range(1, 11))
    assert sorted((r.model, r.fraction) for r in got) == sorted((m, s / 10) for m in lab.MODELS for s in range(1, 11))


def test_joint_codes_count_each_feature():
    r = np.random.default_rng(2)
    codes = np.stack([r.integers(0, n, 500) for n in (32, 32, 5, 2, 2, 17, 1)], 1).astype(np.uint8)
    joint, node, g = T.Joint(codes), r.integers(0, 3, 500), r.normal(size=500)
    assert len(joint.groups) < 4 and sorted(f for names, _ in joint.groups for f in names) == list(range(7))
    got = np.zeros((3, 7, T.BINS))
    for i, cells in enumerate(joint.cells):
        joint.spread(i, np.bincount(joint.columns[i] + node * cells, g, 3 * cells).reshape(3, cells), got)
    for f in range(7):
        assert got[:, f] == pytest.approx(np.bincount(codes[:, f] + node * T.BINS, g, 3 * T.BINS).reshape(3, T.BINS))


@pytest.mark.parametrize("more", [{}, {"l1": 0.5, "l2": 2.0, "min_gain": 0.3}, {"min_child_weight": 6.0, "positive_weight": 4.0}])
@pytest.mark.parametrize("cells", [1, 1_024])
def test_shared_boosting_equals_brute_force(more, cells, monkeypatch):
    """Rows in pieces, sums of joint codes or of each feature, a node's own sums from its parent's."""
    monkeypatch.setattr(T, "PIECE", 60)
    monkeypatch.setattr(T, "SHARED_CELLS", cells << 4)
    monkeypatch.setattr(T, "CELLS", 64)
    x, y = data(250)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 12) / 12)).astype(np.float32) for f in range(WIDTH)]
    codes = T.bin_codes(x, edges)
    p = T.Boost(**({"rounds": 4, "rate": 0.3, "max_depth": 3, "l2": 1.0} | more))
    got, marks, _, _ = T.alone(T.boosted(p, codes, y, np.ones(250, bool), np.arange(250), marks=(2,), part=(0, 1)))
    assert got == pytest.approx(brute_boost(p, codes, y, 4), abs=1e-6) and marks[2] == pytest.approx(brute_boost(p, codes, y, 2), abs=1e-6)
    variance = T.Boost(rounds=3, rate=0.2, max_depth=3, variance=True, min_leaf=5)
    alone, _, _, trees = T.boost(variance, codes, y, np.arange(250) % 5 > 0, np.arange(250), keep=True)
    both, _, _, shared = T.alone(T.boosted(variance, codes, y, np.arange(250) % 5 > 0, np.arange(250), keep=True, part=(0, 1)))
    assert both == pytest.approx(alone) and [v for tree in shared for level in tree for v in level[4]] == pytest.approx(
        [v for tree in trees for level in tree for v in level[4]])


@pytest.mark.parametrize("grid", [0, 1 << 30])
def test_trees_read_candidates_only(grid, monkeypatch):
    """of a node's features those that may become its candidates are read, not all; the trees are those of brute force."""
    monkeypatch.setattr(T, "GRID", grid)
    x, y = data(600)
    x = np.c_[x, np.random.default_rng(1).normal(size=(600, 16)).astype(np.float32)]
    read, kept = [], T.Held.values
    monkeypatch.setattr(T.Held, "values", lambda self, f: read.append(f.size if len(self.sizes) == 1 else 0) or kept(self, f))
    for spec in SPECS:
        spec = T.Spec(**spec.__dict__ | {"n_candidates": 4})
        read.clear()
        got = T.grow(spec, x, None, None, y, np.ones(600, np.int64)).arrays()
        assert sorted(zip(*got, strict=True)) == sorted(brute_extra_tree(spec, x, y)) and 0 < sum(read) < 20


@pytest.mark.parametrize("kind", ["newton_boosting", "leafwise_boosting", "symmetric_boosting", "gradient_boosting", "random_forest"])
def test_boosting_tasks_hold_codes(spark, rows, kind, monkeypatch):
    """beyond one task a boosted model's rows are a byte for each feature."""
    monkeypatch.setattr(lab, "TASK_ROWS", 300)
    seen, kept = [], lab.dealt
    monkeypatch.setattr(lab, "dealt", lambda *a: seen.append(a[6] if len(a) > 6 else False) or kept(*a))
    assert lab.predictions(rows, lab.Fit(kind, {"n_estimators": 2}), WIDTH).count() == rows.where("fold = -1").count()
    assert seen == [kind != "random_forest"]


def test_forest_permutations_equal_scoring_each_variant(spark, rows):
    """rows go down again from where the changed feature takes another side; the scores are those of whole passes."""
    nodes, weight = forest.fit(rows, WIDTH, {"n_estimators": 9, "max_depth": 6, "max_features": None})
    predict, test = xp.forest_predictor(nodes, weight), rows.where(f"fold = {lab.TEST}")
    x = np.array([r.x for r in test.collect()], np.float32)
    other = x[np.random.default_rng(3).permutation(len(x))]
    got = predict.changed(x, other)
    assert got[0] == pytest.approx([np.mean([T.share(n0, n1, weight)[T.leaf_of(v[None], node, f, t)[0]] for node, f, t, n0, n1 in predict.model.value.values()])
                                    for v in x], abs=1e-14)
    for f in range(WIDTH):
        some = x.copy()
        some[:, f] = other[:, f]
        assert (predict(some) == got[1 + f]).all()
    fast = {r.feature: (r.perm_mean, r.perm_std) for r in xp.permutation_importance(test, predict, list("abcd"), repeats=3, keep=True).collect()}
    slow = {r.feature: (r.perm_mean, r.perm_std) for r in xp.permutation_importance(test, lambda v: predict(v), list("abcd"), repeats=3, keep=True).collect()}
    assert fast == slow and len(fast) == WIDTH


def test_blocks_of_scores_give_the_same_auc(spark, monkeypatch):
    """Distinct scores in blocks, of several batches and ranges, against rows; a group of one class has no AUC."""
    r = np.random.default_rng(8)
    y, s = r.integers(0, 2, 400), np.round(r.random(400), 2)
    df = spark.createDataFrame([(1 if i < 380 else 2, int(y[i]) if i < 380 else 1, float(s[i])) for i in range(400)], "g int, label int, score double")
    blocks = []
    for g, some in ((1, range(0, 150)), (1, range(150, 380)), (2, range(380, 400))):
        for cell in range(257):
            at = [i for i in some if int(s[i] * 256) == cell]
            if at:
                v = sorted({s[i] for i in at})
                p = [sum(int(s[i] == a and (y[i] == 1 or g == 2)) for i in at) for a in v]
                q = [sum(int(s[i] == a) for i in at) - n for a, n in zip(v, p, strict=True)]
                blocks.append((g, cell, *(bytearray(np.array(c, k).tobytes()) for c, k in ((v, "f8"), (p, "i4"), (q, "i4")))))
    packed = spark.createDataFrame(blocks, "g int, cell int, scores binary, ps binary, qs binary")
    want, got = ({row.g: row.auc for row in xp.grouped_auc(d, ["g"]).collect()} for d in (df, packed))
    assert got == want and want[2] is None and want[1] == pytest.approx(T.metrics(y[:380], s[:380])["auc"])


@pytest.mark.parametrize("held", [100, 2_000_000])
def test_dealt_trees_equal_brute_force(spark, rows, held, monkeypatch):
    """F15 to F20: beyond one task the forest's rows are dealt once; fit grows the same trees, and a task without rows takes the steps."""
    monkeypatch.setattr(forest, "HELD_ROWS", held)
    train = rows.where("fold >= 0")
    local = sorted(((r.x, r.label) for r in train.collect()), key=repr)
    x, y = np.array([a for a, _ in local], np.float32), np.array([b for _, b in local])
    got = {}
    for r in forest.dealt_trees(train, SPECS, WIDTH, 3).collect():
        got.setdefault(r.tree, []).append(tuple(r)[1:])
    for t, spec in enumerate(SPECS):
        assert sorted(got[t]) == sorted(brute_extra_tree(spec, x, y))
    few = train.where("id < 3")
    assert sorted(map(tuple, forest.dealt_trees(few, SPECS[:2], WIDTH, 4).collect())) == sorted(map(tuple, forest.grow(few, SPECS[:2], WIDTH).collect()))
    monkeypatch.setattr(forest, "grow", None)
    nodes, _ = forest.fit(rows, WIDTH, {"n_estimators": 3, "max_depth": 3}, 200)
    assert nodes.select("tree").distinct().count() == 3


@pytest.mark.parametrize(("pull", "push"), [(0.0, 0.02), (0.001, 0.05), (0.0, 1e-6), (0.01, 1.0)])
def test_penalised_steps_end_at_the_least_cost(pull, push):
    """F8 to F11: also where columns are nearly sums of others, which coordinate by coordinate takes many thousand turns."""
    r = np.random.default_rng(6)
    a = r.normal(size=(300, 8))
    a = np.c_[a, a[:, 0] + a[:, 1] + 1e-4 * r.normal(size=300), a[:, 2] - a[:, 3] + 1e-4 * r.normal(size=300), np.ones(300)]
    hess, b = a.T @ a / 300, np.r_[r.normal(size=5), np.zeros(6)]
    g = hess @ r.normal(size=11)
    u = T.least_quadratic(g, hess, b, pull, push)
    slope = g + hess @ (u - b) + pull * np.r_[u[:-1], 0.0]
    used = u[:-1] != 0
    assert abs(slope[-1]) < 1e-6 and slope[:-1][used] == pytest.approx(-push * np.sign(u[:-1][used]), abs=1e-6)
    assert (np.abs(slope[:-1][~used]) <= push + 1e-6).all()
