"""The forest over dealt rows (MDL-04, SEL-05) against brute force and pyspark.ml."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from roadlens.operators import bagging, forest, lab
from roadlens.operators import explain as xp
from roadlens.operators import train as tr
from roadlens.operators import trees as T

WIDTH = 4


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = np.c_[r.normal(size=1500), r.integers(0, 2, 1500), r.integers(0, 9, 1500), np.full(1500, 7.0)].astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=1500) > 0.8).astype(int)
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                 "id long, label int, x array<float>").repartition(3).cache()


def brute(spec, codes, cuts, y, w, node=1, depth=0):
    """The best weighted Gini split of each node over its candidates' bins; rows count as often as they are drawn."""
    n0, n1 = float(w[y == 0].sum()), float(w[y == 1].sum())
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    c0, c1 = spec.class_weight
    order = sorted(range(codes.shape[1]), key=lambda f: float(T.uniform(spec.seed, node, 1000 + f)))
    found = []
    for f in order[:spec.n_candidates] if depth < spec.max_depth else []:
        for c in range(T.BINS):
            go = codes[:, f] <= c
            a, b = float(w[go & (y == 0)].sum()), float(w[go & (y == 1)].sum())
            if min(a + b, n0 + n1 - a - b) >= spec.min_leaf:
                found.append((gini(c0 * n0, c1 * n1) - gini(c0 * a, c1 * b) - gini(c0 * (n0 - a), c1 * (n1 - b)), f, c))
    top = max((g[0] for g in found), default=0.0)
    if top <= 1e-12:
        return [(node, -1, 0.0, n0, n1)]
    _, f, c = next(g for g in found if g[0] >= top - 1e-9 * max(1.0, top))
    go = codes[:, f] <= c
    sides = [brute(spec, codes[s], cuts, y[s], w[s], 2 * node + i, depth + 1) for i, s in enumerate((go, ~go))]
    if all(len(s) == 1 for s in sides) and len({c1 * s[0][4] > c0 * s[0][3] for s in sides}) == 1:
        return [(node, -1, 0.0, n0, n1)]                                   # both leaves predict the same
    return [(node, f, float(cuts[f, c]), n0, n1), *sides[0], *sides[1]]


@pytest.mark.parametrize("tasks", [1, 3])
def test_trees_equal_brute_force_whatever_the_tasks(spark, rows, tasks):
    nodes, weight = bagging.fit(rows, WIDTH, 8, 5, 5, 42, tasks)
    edges = lab.bin_edges(rows.withColumn("fold", F.lit(0)), WIDTH)
    local = sorted(rows.select(F.xxhash64("id", "label", "x"), "label", "x").collect())
    rid, y = np.array([r[0] for r in local]), np.array([r[1] for r in local])
    codes = T.bin_codes(np.array([r[2] for r in local], np.float32), edges)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.tree, []).append(tuple(r)[1:])
    for k in range(8):
        spec = T.Spec(seed=42 * 100_003 + k, n_candidates=2, max_depth=5, min_leaf=5, class_weight=weight)
        want = brute(spec, codes, T.edge_table(edges), y, T.poisson_weights(spec.seed, rid))
        assert sorted(got[k]) == sorted(want) and len(want) > 1


def test_agrees_with_the_estimator(spark, rows):
    """Scores and importances differ from pyspark.ml's by the draws only."""
    names = [f"f{i}" for i in range(WIDTH)]
    train = tr.prepare(rows.select("id", "label", *[F.col("x")[i].alias(f) for i, f in enumerate(names)]), names, "label")
    model = tr.estimators(1500)["random_forest"].setNumTrees(60).setMaxDepth(5).fit(train)
    nodes, weight = bagging.fit(rows, WIDTH, 60, 5, 5, 42)
    want = {r.id: r.score for r in tr.predictions(model, train).collect()}
    got = {r.id: r.score for r in forest.score(rows, nodes, weight, WIDTH).collect()}
    ids = sorted(want)
    a, b = np.array([want[i] for i in ids]), np.array([got[i] for i in ids])
    assert sorted(got) == ids and np.abs(a - b).mean() < 0.03 and np.corrcoef(a, b)[0, 1] > 0.98
    imp = {r.feature: r.importance for r in xp.forest_importance(bagging.split_trees(nodes), weight, names).collect()}
    assert [imp[f] for f in names] == pytest.approx(model.featureImportances.toArray().tolist(), abs=0.06)
    assert sum(imp.values()) == pytest.approx(1.0)


def test_odd_rows(spark, rows):
    copies = spark.range(400).select(F.lit(None).cast("long").alias("id"), (F.col("id") % 2).cast("int").alias("label"),
                                     F.array(*[F.lit(1.0).cast("float")] * WIDTH).alias("x"))
    nodes, _ = bagging.fit(copies, WIDTH, 5, 3, 5, 42, 3)                  # one task has no rows
    assert [r.feature for r in nodes.collect()] == [-1] * 5
    drawn = [r.n0 + r.n1 for r in nodes.collect()]
    assert all(250 < d < 550 and d % 200 for d in drawn)                    # each copy is drawn by itself
    assert bagging.split_trees(nodes).count() == 0
    one, _ = bagging.fit(rows.withColumn("label", F.lit(0)), WIDTH, 2, 3, 5, 42)
    assert [r.feature for r in one.collect()] == [-1] * 2


def test_large_tables_do_not_go_through_the_estimator(spark, monkeypatch, tmp_path):
    """F1, F25: beyond TASK_ROWS the rows are dealt; all test rows are scored and all features ranked."""
    from pyspark.ml.classification import RandomForestClassifier

    def never(*_):
        raise AssertionError("pyspark.ml over a large table")

    spark.sql("SELECT id AS event_id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 37 % 40000 AS INT)) AS ts, id % 50 AS user_id, "
              "element_at(array('error', 'click', 'view'), CAST(id % 3 AS INT) + 1) AS event_type, CAST(id * 31 % 200 AS DOUBLE) AS value, '{}' AS props "
              "FROM range(1000)").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    monkeypatch.setattr(lab, "TASK_ROWS", 300)
    scored = E.queries()["mdl_04"](spark, str(tmp_path))
    assert scored.columns == ["id", "label", "score", "pred"]
    got = scored.collect()
    assert sorted(r.id for r in got) == list(range(0, 1000, 5)) and all(0 <= r.score <= 1 and r.pred == (r.score >= 0.5) for r in got)
    ranked = E.queries()["sel_05"](spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 24)) and sum(r.importance for r in ranked) == pytest.approx(1.0)
