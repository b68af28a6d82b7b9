"""Literal fixtures with the edge rows of FIXTURES.md section 6, answers computed by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from roadlens.functions import geo, temporal, text
from roadlens.functions.common import np_round
from roadlens.operators import encode, impute, prefix, rates, rolling


def test_half_even_rounding_matches_numpy(spark):
    vals = [0.125, 2.5, 0.03095, 0.03085, 0.12345, -0.03095, 1.0000049999]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 4)).collect()]
    assert got == [float(np.round(v, 4)) for v in vals]


def test_radial_band_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.0001,), (20.0,), (20.5,), (None,)], "d double")
    got = [r[0] for r in df.select(geo.radial_band("d")).collect()]
    assert got == [0, 0, 1, 3, 4, None]


def test_hour_bins_and_peaks(spark):
    rows = [(h,) for h in (-1, 0, 3, 4, 7, 8, 13, 14, 18, 19, 20, 23)]
    df = spark.createDataFrame(rows, "h int")
    got = [(r[0], r[1]) for r in df.select(temporal.hour_bin_label("h"), temporal.hour_bin_code("h")).collect()]
    assert got == [("unknown", -1), ("deep_night", 0), ("deep_night", 0), ("early_morn", 1), ("early_morn", 1),
                   ("daytime", 2), ("daytime", 2), ("afternoon", 3), ("afternoon", 3), ("evening", 4),
                   ("evening", 4), ("evening", 4)]
    q = [r[0] for r in df.select(temporal.hour_quadrant("h")).collect()]
    assert q == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


def test_weekday_monday_zero_and_null_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8, 0),), (dt.datetime(2024, 1, 7, 23, 0),), (None,)],
                               "ts timestamp")
    got = [tuple(r) for r in df.select(*temporal.calendar_parts("ts")).collect()]
    assert got == [(8, 0, 1), (23, 6, 1), (-1, -1, -1)]
    flags = [tuple(r) for r in df.select(*temporal.peak_flags("ts")).collect()]
    assert flags == [(0, 0, 0), (1, 0, 1), (0, 0, 0)]


def test_nearest_anchor_ties_go_to_first(spark):
    anchors = [("a", 13.0, 77.5), ("b", 13.0, 77.7)]  # equidistant from (13.0, 77.6)
    df = spark.createDataFrame([(13.0, 77.6)], "latitude double, longitude double")
    d, i = df.select(*geo.nearest_anchor(anchors=anchors)).first()
    assert i == 0 and d > 0


def test_haversine_zero_and_known_distance(spark):
    df = spark.createDataFrame([(12.9716, 77.5946)], "latitude double, longitude double")
    assert df.select(geo.haversine_km("latitude", "longitude", 12.9716, 77.5946)).first()[0] == 0.0
    km = df.select(geo.haversine_km("latitude", "longitude", 13.1989, 77.7068)).first()[0]
    assert 27.9 < km < 28.2


def test_word_count_whitespace(spark):
    df = spark.createDataFrame([("  a  b c\td ",), ("",), (None,), ("one",)], "t string")
    assert [r[0] for r in df.select(text.word_count("t")).collect()] == [4, 0, 0, 1]


def test_keyword_inside_word_and_case(spark):
    df = spark.createDataFrame([("Truckload BLOCKED",), ("nothing",)], "d string")
    got = [tuple(r) for r in df.select(*text.keyword_flags("d", ["truck", "block", "bus"], "d")).collect()]
    assert got == [(1, 1, 0), (0, 0, 0)]


def test_case_sensitive_cause_lookup(spark):
    from roadlens.operators.events import cause_scores
    df = spark.createDataFrame([("Debris",), ("debris",), ("unknown",), (None,)], "event_cause string")
    got = [r[0] for r in df.select(cause_scores()[0]).collect()]
    assert got == [0.083, 1.0, 0.083, 0.083]


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert impute.fit_mode(df, ["c"]) == {"c": "a"}
    t = impute.mode_table(df, ["c"]).collect()
    assert t[0]["mode_value"] == "a"


def test_smoothed_rate_min_count(spark):
    rows = [("x", 1)] * 4 + [("x", 0)] * 1 + [("y", 1)] * 2
    df = spark.createDataFrame(rows, "k string, y int")
    t = {r["k"]: r["r"] for r in rates.smoothed_rate_table(df, ["k"], "y", 10, 0.5, min_count=3, out="r").collect()}
    assert abs(t["x"] - (5 * 0.8 + 10 * 0.5) / 15) < 1e-12
    assert t["y"] == 0.5  # below min_count -> prior


def test_unseen_category_label_is_minus_one(spark):
    tr = spark.createDataFrame([("a",), ("c",), ("b",)], "k string")
    te = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    got = [r["k_label"] for r in encode.label_encode(te, tr, ["k"]).orderBy(F.col("k").asc_nulls_last()).collect()]
    assert got == [0, -1, -1]


def test_positions_independent_of_partition_count(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 503).alias("v"), F.col("id"))
    ref = None
    for n in (1, 4, 16):
        got = {r["id"]: r["pos"] for r in prefix.global_positions(df, ["v", "id"], num_partitions=n).collect()}
        if ref is None:
            ref = got
        assert got == ref
    expected = {i: p for p, (_, i) in enumerate(sorted((v, i) for i, v in ((i, i * 7919 % 503) for i in range(500))))}
    assert ref == expected


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    vals = [0.0] * 300 + [float(i) for i in range(1, 301)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = {r["p"]: r["value"] for r in prefix.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75, 0.9]).collect()}
    arr = np.array([v for v in vals if v is not None])
    for p in (0.25, 0.5, 0.75, 0.9):
        assert abs(q[p] - np.percentile(arr, p * 100)) < 1e-9


def test_rolling_half_open_window_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    times = [0, 0, 30, 179, 180, 181, 600, 601, 601, 2000]  # minutes; equal stamps, gap > window
    tr = spark.createDataFrame([(i, base + dt.timedelta(minutes=m)) for i, m in enumerate(times)], "id long, ts timestamp")
    q = spark.createDataFrame([(100 + i, base + dt.timedelta(minutes=m)) for i, m in enumerate(times)]
                              + [(999, None)], "id long, ts timestamp")
    got = {r["id"]: r["rolling_3h_system_count"] for r in rolling.window_counts(q, tr, 3).collect()}
    for i, m in enumerate(times):
        exp = sum(1 for t in times if m - 180 <= t < m)
        assert got[100 + i] == exp
    assert got[999] == 0


def test_empty_frame_transforms(spark):
    from roadlens.operators import features as feat
    from roadlens.sources.tables import incidents
    inc = incidents(spark, "/root/testdata/sf0.001").limit(0)
    ctx = feat.prepare_context(inc)
    out = feat.rate_feature(ctx, ctx, ["zone"], "requires_road_closure", "z", 10, 0.1)
    assert out.count() == 0 and "z" in out.columns


def test_rolling_per_key_with_hot_key_and_burst(spark):
    """Per-corridor counts vs brute force; one key holds most rows and a burst of equal stamps."""
    import random
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])
        minute = 500 if i % 10 == 0 else rnd.randint(0, 2000)   # burst at minute 500
        rows.append((i, key, base + dt.timedelta(minutes=minute)))
    rows.append((999, "a", None))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    tr = df.filter("id % 2 = 0")
    got = {r["id"]: (r["c3"], r["c6"]) for r in rolling.window_counts(df, tr, [3, 6], by=["k"], out=["c3", "c6"],
                                                                       ).collect()}
    trl = [(k, t) for i, k, t in rows if i % 2 == 0 and t is not None and k is not None]
    for i, k, t in rows:
        if t is None or k is None:
            assert got[i] == (0, 0)
            continue
        exp = tuple(sum(1 for k2, t2 in trl if k2 == k and t - dt.timedelta(hours=h) <= t2 < t) for h in (3, 6))
        assert got[i] == exp, (i, got[i], exp)


def test_weighted_prefix_partition_independent(spark):
    from roadlens.operators.prefix import weighted_prefix
    df = spark.range(0, 400).select("id", (F.col("id") % 4).cast("string").alias("g"),
                                    (F.col("id") % 5).cast("double").alias("w"))
    ref = None
    for n in (1, 3, 16):
        got = {r["id"]: r["p"] for r in weighted_prefix(df, ["id"], ["g"], "w", "p", num_partitions=n).collect()}
        ref = ref or got
        assert got == ref
    for i in range(400):
        exp = sum(j % 5 for j in range(i) if j % 4 == i % 4)
        assert ref[i] == exp


def test_auc_matches_spark_evaluator_with_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from roadlens.operators.evaluate import auc
    rows = [(i, i % 3 == 0 and 1 or 0, round((i * 37 % 11) / 10.0, 1)) for i in range(300)]  # many tied scores
    df = spark.createDataFrame(rows, "id long, label int, score double")
    ours = auc(df).first()["auc"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        df.select("score", F.col("label").cast("double").alias("label")))
    # brute force Mann-Whitney
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    bf = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(ours - bf) < 1e-12 and abs(ref - bf) < 1e-9


def test_bracketed_quantiles_coarse_sketch(spark):
    """Coarse sketch (accuracy 20) forces wide brackets: interior ranks, hot values, extremes."""
    import random
    rnd = random.Random(3)
    a = [rnd.uniform(0, 100) for _ in range(1500)] + [42.0] * 700          # hot value
    b = [float(i % 7) for i in range(2200)]                                # few distinct values
    df = spark.createDataFrame([(x, y) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in prefix.exact_quantiles(df, ["a", "b"], probs, accuracy=20).collect()}
    for col, vals in (("a", a), ("b", b)):
        for p in probs:
            assert abs(got[(col, p)] - np.percentile(np.array(vals), p * 100)) < 1e-9, (col, p)


def test_timestamp_parse_offsets_and_garbage(spark):
    from roadlens.operators.clean import ts_parse_flag
    rows = [("2024-01-01T10:00:00+05:30",), ("2024-01-01 10:00:00",), ("not a date",), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(temporal.parse_ts("s").alias("t"), ts_parse_flag("s").alias("bad")).collect()
    assert got[0]["t"] == dt.datetime(2024, 1, 1, 4, 30)      # offset honoured, session zone UTC
    assert got[1]["t"] == dt.datetime(2024, 1, 1, 10, 0)
    assert [r["bad"] for r in got] == [0, 0, 1, 1, 1]


def test_validation_messages(spark):
    from roadlens.operators.clean import validate_rows
    rows = [("2024-01-01 10:00:00", 12.9, 77.6), ("bad", 13.9, None), (None, None, 77.5)]
    df = spark.createDataFrame(rows, "start_datetime string, latitude double, longitude double")
    got = [(r["errors"], r["is_valid"]) for r in validate_rows(df).collect()]
    assert got[0] == ([], True)
    assert got[1] == (["start_datetime is not a valid timestamp", "latitude outside service area",
                       "longitude is required"], False)
    assert got[2] == (["start_datetime is required", "latitude is required"], False)


def test_bracketed_quantiles_distributed_interior(spark, monkeypatch):
    """Force the large-interior path (exact positions via P1) and compare with numpy."""
    import random
    monkeypatch.setattr(prefix, "MAX_LOCAL_INTERIOR", 0)
    rnd = random.Random(5)
    a = [rnd.gauss(50, 20) for _ in range(2000)] + [10.0] * 500
    df = spark.createDataFrame([(x,) for x in a], "a double")
    probs = [0.1, 0.25, 0.5, 0.9]
    got = {r["p"]: r["value"] for r in prefix.exact_quantiles(df, ["a"], probs, accuracy=20).collect()}
    for p in probs:
        assert abs(got[p] - np.percentile(np.array(a), p * 100)) < 1e-9, p


def test_redundant_pairs_are_pairwise_complete_at_any_width(spark, monkeypatch):
    """NULLs in one column must not change the correlation of two others, however many passes it takes."""
    from roadlens.operators import select as sel
    rows = [(float(i), float(i) * 2 + (i % 3), float(i % 7) if i % 4 else None, float(-i) + (i % 2) * 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    feats = ["a", "b", "c", "d"]

    def found():
        return {(r["feature_a"], r["feature_b"]): r["abs_corr"] for r in sel.redundant_pairs(df, feats, 0.0).collect()}
    one = found()
    monkeypatch.setattr(sel, "PAIRS_PER_PASS", 2)
    several = found()
    assert one.keys() == several.keys() and len(one) == 6
    assert all(abs(one[k] - several[k]) < 1e-12 for k in one)
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert abs(one[("a", "b")] - abs(np.corrcoef(a, b)[0, 1])) < 1e-12


def test_heat_surface_neighbourhood_is_exact(spark):
    """Brute force over a 7x7 cell neighbourhood: no cell outside the 3x3 ring ever gets weight."""
    import math
    import random
    from roadlens.operators.dashboards import heat_surface
    rnd = random.Random(11)
    pts = [(12.8 + rnd.random() * 0.4, 77.3 + rnd.random() * 0.4) for _ in range(150)]
    df = spark.createDataFrame(pts, "latitude double, longitude double")
    got = {(r["cell_lat"], r["cell_lon"]): r["heat"] for r in heat_surface(df).collect()}

    def hav(la1, lo1, la2, lo2):
        r = math.radians
        a = math.sin((r(la2) - r(la1)) / 2) ** 2 + math.cos(r(la1)) * math.cos(r(la2)) * math.sin((r(lo2) - r(lo1)) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))
    exp: dict = {}
    for la, lo in pts:
        bl, bn = math.floor(la / 0.01), math.floor(lo / 0.01)
        for dl in range(-3, 4):
            for dn in range(-3, 4):
                cl, cn = bl + dl, bn + dn
                d = hav(la, lo, (cl + 0.5) * 0.01, (cn + 0.5) * 0.01)
                w = (0.22 if d <= 0.12 else 0) + (0.07 if d <= 0.4 else 0) + (0.03 if d <= 0.8 else 0)
                if w > 0:
                    assert abs(dl) <= 1 and abs(dn) <= 1
                    exp[(cl, cn)] = exp.get((cl, cn), 0.0) + w
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - round(exp[k], 6)) < 1e-6 for k in exp)
