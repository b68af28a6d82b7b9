"""Evaluation (EVL-01..06) and feature scoring/selection (SEL-01..04, 07..12, TXT-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.constants import CAUSE_PRIORITY, CAUSE_SEVERITY, CITY_CENTRE, AIRPORT, FEATURE_CATEGORIES, VEHICLE_RISK
from roadlens.functions import geo, temporal, text
from roadlens.operators import evaluate as ev
from roadlens.operators import events
from roadlens.operators import select as sel
from roadlens.operators.prefix import stratified_folds
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.sources.tables import incidents, read_table, scored_labels

THRESHOLD = 0.35
D = O.d

# ------------------------------------------------------------------ evaluation (scored labels)

_S = O.SCORED_LABELS_SQL
_MIX = "((id % 4294967296) * 40503 + 42 * 7919) % 4294967296"


def _conf_sql(src: str, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel_by}tn, fp, fn, tp,
  CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS sensitivity
FROM (SELECT {sel_by}count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
      FROM {src} {grp})"""


@register("evl_01", f"WITH s AS ({_S}), p AS (SELECT label, CAST(score >= {THRESHOLD} AS INTEGER) AS pred FROM s) "
          + _conf_sql("p"))
def evl_01(spark, sf):
    s = scored_labels(spark, sf)
    return ev.confusion_metrics(s.select("label", (F.col("score") >= THRESHOLD).cast("int").alias("pred")))


def _auc_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    part_s = f"PARTITION BY {by}, score" if by else "PARTITION BY score"
    sel_by = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return (f"SELECT {sel_by}CASE WHEN sum(label) = 0 OR sum(1 - label) = 0 THEN NULL ELSE "
            f"(sum(mid * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) END AS auc FROM "
            f"(SELECT {sel_by}label, avg(rn) OVER ({part_s}) AS mid FROM "
            f"(SELECT {sel_by}label, score, row_number() OVER ({part} ORDER BY score, id) AS rn FROM {src})) {grp}")


@register("evl_02", f"WITH s AS ({_S}) " + _auc_sql("s"))
def evl_02(spark, sf):
    return ev.auc(scored_labels(spark, sf))


@register("evl_03", f"""WITH s AS ({_S}),
b AS (SELECT CAST(least(greatest(floor(score * 14.0), 0), 14) AS INTEGER) AS bucket, count(*) FILTER (WHERE label = 1) AS np,
             count(*) FILTER (WHERE label = 0) AS nn FROM s GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS bucket)
SELECT g.bucket / 14.0 AS threshold,
       sum(coalesce(np, 0)) OVER (ORDER BY g.bucket DESC ROWS UNBOUNDED PRECEDING) / (SELECT sum(np) FROM b) AS tpr,
       sum(coalesce(nn, 0)) OVER (ORDER BY g.bucket DESC ROWS UNBOUNDED PRECEDING) / (SELECT sum(nn) FROM b) AS fpr
FROM g LEFT JOIN b ON g.bucket = b.bucket""")
def evl_03(spark, sf):
    return ev.roc_points(scored_labels(spark, sf))


_FOLDS_SQL = (f"SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {_MIX}, id) - 1) % 5 AS INTEGER) AS fold "
              f"FROM s")


@register("evl_04", f"""WITH s AS ({_S}), f AS ({_FOLDS_SQL}),
p AS (SELECT fold, label, CAST(score >= {THRESHOLD} AS INTEGER) AS pred FROM f),
m AS ({_conf_sql('p', 'fold')})
SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM
  (UNPIVOT (SELECT accuracy, precision, recall, f1 FROM m) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)
GROUP BY metric""")
def evl_04(spark, sf):
    s = stratified_folds(scored_labels(spark, sf), "label", "id")
    per_fold = ev.confusion_metrics(s.select("fold", "label", (F.col("score") >= THRESHOLD).cast("int").alias("pred")),
                                    by=["fold"])
    return ev.fold_summary(per_fold, ["accuracy", "precision", "recall", "f1"])


MODELS = [("len_500", 500.0), ("len_2000", 2000.0), ("len_8000", 8000.0)]
METRICS = ["auc", "accuracy", "precision", "recall", "f1"]


def model_results(spark, sf) -> DataFrame:
    """Three rule scorers over the same labelled rows -> one metrics row per model."""
    lab = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    base = lab.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "n_chars")
    arr = F.array(*[F.struct(F.lit(m).alias("model"), (F.col("n_chars").cast("double") / (F.col("n_chars") + F.lit(k)))
                             .alias("score")) for m, k in MODELS])
    long = base.select("id", "label", F.explode(arr).alias("m")).select("id", "label", "m.model", "m.score")
    conf = ev.confusion_metrics(long.select("model", "label", (F.col("score") >= THRESHOLD).cast("int").alias("pred")),
                                by=["model"])
    a = ev.auc(long, by=["model"])
    return conf.join(a, "model").select("model", *METRICS)


_MODELS_SQL = ("SELECT l.doc_id AS id, l.quality AS label, m.model, CAST(d.n_chars AS DOUBLE) / (d.n_chars + m.k) AS score "
               "FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (VALUES " +
               ", ".join(f"('{m}', {D(k)})" for m, k in MODELS) + ") m(model, k)")
_RESULTS_SQL = f"""ms AS ({_MODELS_SQL}),
mp AS (SELECT model, label, CAST(score >= {THRESHOLD} AS INTEGER) AS pred FROM ms),
mc AS ({_conf_sql('mp', 'model')}),
ma AS ({_auc_sql('ms', 'model')}),
res AS (SELECT mc.model, ma.auc, accuracy, precision, recall, f1 FROM mc JOIN ma ON mc.model = ma.model)"""


@register("evl_05", f"""WITH {_RESULTS_SQL}
SELECT model, {", ".join(METRICS)}, {", ".join(f"rank() OVER (ORDER BY {m} DESC) AS rank_{m}" for m in METRICS)},
       {" + ".join(f"rank() OVER (ORDER BY {m} DESC)" for m in METRICS)} AS rank_sum,
       rank() OVER (ORDER BY {" + ".join(f"r_{m}" for m in METRICS)}) AS overall_rank
FROM (SELECT *, {", ".join(f"rank() OVER (ORDER BY {m} DESC) AS r_{m}" for m in METRICS)} FROM res)""")
def evl_05(spark, sf):
    return ev.composite_ranking(model_results(spark, sf), METRICS)


@register("evl_06", f"""WITH {_RESULTS_SQL}
SELECT metric, model, value, position FROM (SELECT metric, model, value, row_number() OVER (PARTITION BY metric
  ORDER BY value DESC, model) AS position FROM (UNPIVOT res ON {", ".join(METRICS)} INTO NAME metric VALUE value))
WHERE position <= 3""")
def evl_06(spark, sf):
    return ev.best_per_metric(model_results(spark, sf), METRICS)


# ------------------------------------------------------------------ feature scoring (incident features)

FEATURES = ["cause_severity_score", "cause_priority_score", "veh_type_risk_score", "is_heavy_vehicle",
            "is_public_transport", "is_high_closure_risk", "is_planned_event", "is_weekend", "is_morning_peak",
            "is_night_peak", "hour", "day_of_week", "dist_to_city_centre", "dist_to_airport", "lat_lon_product",
            "num_lanes", "description_len_words", "latitude", "longitude", "lat_grid_cell", "lon_grid_cell",
            "time_since_midnight_min", "hour_quadrant"]
LABEL = "requires_road_closure"


def feature_matrix(spark, sf) -> DataFrame:
    inc = incidents(spark, sf)
    base = inc.select("id", LABEL, "num_lanes", "event_type", *events.cause_scores(),
                      *events.vehicle_features(F.coalesce("veh_type", F.lit("nan"))),
                      events.planned_flag().alias("is_planned_event"), *temporal.peak_flags("ts"),
                      temporal.calendar_parts("ts")[0], temporal.calendar_parts("ts")[1],
                      *geo.city_distances(), geo.lat_lon_product().alias("lat_lon_product"),
                      text.word_count("description").alias("description_len_words"), "latitude", "longitude",
                      *geo.grid_cells(), temporal.minutes_of_day("ts")[0])
    return (base.withColumn("is_high_closure_risk", events.high_closure_flag())
            .withColumn("hour_quadrant", temporal.hour_quadrant("hour")))


def _matrix_sql():
    from roadlens.constants import HEAVY_VEHICLES, PUBLIC_TRANSPORT
    from roadlens.functions.text import WS_CLASS
    sev = f"round_even({O.dmap('event_cause', CAUSE_SEVERITY, 0.083)}, 4)"
    return f"""SELECT id, requires_road_closure, {sev} AS cause_severity_score,
  round_even({O.dmap('event_cause', CAUSE_PRIORITY, 0.598)}, 4) AS cause_priority_score,
  round_even({O.dmap("coalesce(veh_type, 'nan')", VEHICLE_RISK, 0.044)}, 4) AS veh_type_risk_score,
  {O.flag('veh_type IN ' + O.in_list(HEAVY_VEHICLES))} AS is_heavy_vehicle,
  {O.flag('veh_type IN ' + O.in_list(PUBLIC_TRANSPORT))} AS is_public_transport,
  {O.flag(sev + ' >= 0.25')} AS is_high_closure_risk, {O.flag("event_type = 'planned'")} AS is_planned_event,
  {O.flag('isodow(ts) - 1 >= 5')} AS is_weekend, {O.flag('coalesce(hour(ts), -1) BETWEEN 4 AND 7')} AS is_morning_peak,
  {O.flag('coalesce(hour(ts), -1) BETWEEN 19 AND 23')} AS is_night_peak, coalesce(hour(ts), -1) AS hour,
  coalesce(isodow(ts) - 1, -1) AS day_of_week,
  round_even({O.hav('latitude', 'longitude', *CITY_CENTRE)}, 3) AS dist_to_city_centre,
  round_even({O.hav('latitude', 'longitude', *AIRPORT)}, 3) AS dist_to_airport,
  round_even(latitude * longitude, 6) AS lat_lon_product, num_lanes,
  CAST(len(list_filter(regexp_split_to_array(coalesce(description, ''), '[{WS_CLASS}]+'), lambda x: x <> '')) AS INTEGER)
    AS description_len_words, latitude, longitude, CAST(trunc(latitude / 0.01) AS INTEGER) AS lat_grid_cell,
  CAST(trunc(longitude / 0.01) AS INTEGER) AS lon_grid_cell,
  coalesce(hour(ts) * 60 + minute(ts), -1) AS time_since_midnight_min,
  CAST(least(greatest(floor(coalesce(hour(ts), -1) / 6), 0), 3) AS INTEGER) AS hour_quadrant FROM incidents"""


_LONG = f"SELECT feature, CAST(x AS DOUBLE) AS x, y FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)}, requires_road_closure AS y FROM fm) ON {', '.join(FEATURES)} INTO NAME feature VALUE x)"

_SCORES_SQL = dict(
    fm=_matrix_sql(), lg=_LONG,
    pb="SELECT feature, abs(coalesce(CASE WHEN isnan(corr(x, CAST(y AS DOUBLE))) THEN 0.0 ELSE corr(x, CAST(y AS DOUBLE)) END, 0.0)) AS abs_corr FROM lg GROUP BY feature",
    mm="SELECT feature, min(x) AS lo, max(x) AS hi, count(*) AS n_total FROM lg GROUP BY feature",
    qc="SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM lg GROUP BY feature",
    mi_c="SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n_total FROM (SELECT feature, bin, y, count(*) AS nxy FROM "
         "(SELECT lg.feature, y, len(list_filter(cuts, lambda c: c < x)) AS bin FROM lg JOIN qc ON lg.feature = qc.feature WHERE x IS NOT NULL) "
         "GROUP BY feature, bin, y)",
    mi="SELECT feature, sum(pxy * ln(pxy / (px * py))) AS mutual_info FROM (SELECT feature, nxy / n_total AS pxy, "
       "sum(nxy) OVER (PARTITION BY feature, bin) / n_total AS px, sum(nxy) OVER (PARTITION BY feature, y) / n_total AS py FROM mi_c) "
       "GROUP BY feature",
    ch_o="SELECT lg.feature, y, n_total, sum(CASE WHEN hi = lo THEN 0.0 ELSE (x - lo) / (hi - lo) END) AS o, count(*) AS n "
         "FROM lg JOIN mm ON lg.feature = mm.feature GROUP BY ALL",
    ch="SELECT feature, sum(CASE WHEN e > 0 THEN pow(o - e, 2) / e ELSE 0.0 END) AS chi2 FROM "
       "(SELECT feature, o, n / n_total * sum(o) OVER (PARTITION BY feature) AS e FROM ch_o) GROUP BY feature",
    an_c="SELECT feature, y, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM lg GROUP BY ALL",
    an_t="SELECT feature, count(*) AS n_total, avg(x) AS grand_mean, count(DISTINCT y) AS k FROM lg GROUP BY feature",
    an="SELECT c.feature, CASE WHEN sum((n - 1) * coalesce(v, 0.0)) = 0 OR any_value(k) < 2 THEN 0.0 ELSE "
       "(sum(n * pow(m - grand_mean, 2)) / (any_value(k) - 1)) / (sum((n - 1) * coalesce(v, 0.0)) / (any_value(n_total) - any_value(k))) END "
       "AS f_score FROM an_c c JOIN an_t t ON c.feature = t.feature GROUP BY c.feature",
    sc="SELECT pb.feature, abs_corr, mutual_info, chi2, f_score FROM pb JOIN mi ON pb.feature = mi.feature "
       "JOIN ch ON pb.feature = ch.feature JOIN an ON pb.feature = an.feature",
)


def _with_scores(body: str, **extra) -> str:
    return O.with_ctes(body, **_SCORES_SQL, **extra)


def _r(c):
    return f"round({c}, 6) AS {c}"


def _scores(spark, sf):
    return sel.score_table(feature_matrix(spark, sf), FEATURES, LABEL)


def _round_cols(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("sel_01", _with_scores("SELECT feature, round(abs_corr, 6) AS abs_corr FROM pb"))
def sel_01(spark, sf):
    stats = sel.class_stats(feature_matrix(spark, sf), FEATURES, LABEL)
    return _round_cols(sel.point_biserial(stats), ["abs_corr"])


@register("sel_02", _with_scores("SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi"))
def sel_02(spark, sf):
    return _round_cols(sel.quantile_mutual_info(feature_matrix(spark, sf), FEATURES, LABEL), ["mutual_info"])


@register("sel_03", _with_scores("SELECT feature, round(chi2, 6) AS chi2 FROM ch"))
def sel_03(spark, sf):
    stats = sel.class_stats(feature_matrix(spark, sf), FEATURES, LABEL)
    return _round_cols(sel.chi2(stats), ["chi2"])


@register("sel_04", _with_scores("SELECT feature, round(f_score, 4) AS f_score FROM an"))
def sel_04(spark, sf):
    return sel.anova_f(sel.class_stats(feature_matrix(spark, sf), FEATURES, LABEL)).select("feature", F.round("f_score", 4).alias("f_score"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM fm"
    for a, b in _PAIRS)
# redundancy is looked for within the 30 best features
_RED = ("SELECT feature_a, feature_b, round(ar, 6) AS abs_corr, CASE WHEN ar >= 0.95 THEN 'drop one' ELSE 'review' END "
        "AS advice FROM (SELECT feature_a, feature_b, abs(CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE r END) AS ar "
        f"FROM ({_PAIRS_SQL})) WHERE ar >= 0.90 AND feature_a IN (SELECT feature FROM rk WHERE place <= 30) "
        "AND feature_b IN (SELECT feature FROM rk WHERE place <= 30)")


def _ranked_sql():
    rk = ", ".join(f"rank() OVER (ORDER BY {m} DESC) AS rank_{m}" for m in sel.METHODS)
    mean = " + ".join(f"rank() OVER (ORDER BY {m} DESC)" for m in sel.METHODS)
    cat = "CASE " + " ".join(f"WHEN starts_with(lower(feature), '{p}') THEN '{c}'" for p, c in FEATURE_CATEGORIES) + " ELSE 'Other' END"
    return (f"SELECT *, rank() OVER (ORDER BY mean_rank) AS ensemble_rank, row_number() OVER (ORDER BY mean_rank, feature) AS place "
            f"FROM (SELECT feature, {', '.join(sel.METHODS)}, {rk}, round_even(({mean}) / {float(len(sel.METHODS))}, 3) AS mean_rank, "
            f"{cat} AS category FROM sc)")


def _ranked(spark, sf):
    return sel.consensus(_scores(spark, sf), categories=FEATURE_CATEGORIES)


def _redundant(spark, sf, ranked):
    best = {r["feature"] for r in sel.top_subsets(ranked, (30,)).collect()}       # at most 30 names
    return sel.redundant_pairs(feature_matrix(spark, sf), [f for f in FEATURES if f in best])


@register("sel_07", _with_scores(_RED, rk=_ranked_sql()))
def sel_07(spark, sf):
    r = _redundant(spark, sf, _ranked(spark, sf))
    return r.select("feature_a", "feature_b", F.round("abs_corr", 6).alias("abs_corr"), "advice")


@register("sel_08", _with_scores(
    "SELECT feature, " + ", ".join(f"rank_{m}" for m in sel.METHODS) + ", mean_rank, ensemble_rank, category FROM rk",
    rk=_ranked_sql()))
def sel_08(spark, sf):
    return _ranked(spark, sf).select("feature", *[f"rank_{m}" for m in sel.METHODS], "mean_rank", "ensemble_rank",
                                     "category")


@register("sel_09", _with_scores(
    "SELECT k, feature, ensemble_rank FROM rk, (VALUES (10), (20), (30)) t(k) WHERE place <= k", rk=_ranked_sql()))
def sel_09(spark, sf):
    return sel.top_subsets(_ranked(spark, sf))


@register("sel_10", _with_scores(
    "SELECT category, count(*) AS n_features, count(*) FILTER (WHERE ensemble_rank <= 10) AS n_top10, "
    "count(*) FILTER (WHERE ensemble_rank <= 30) AS n_top30, min(ensemble_rank) AS best_rank, "
    "round(avg(abs_corr), 6) AS mean_abs_corr, round(avg(mutual_info), 6) AS mean_mi, round(avg(f_score), 4) AS mean_f "
    "FROM rk GROUP BY category", rk=_ranked_sql()))
def sel_10(spark, sf):
    out = sel.category_summary(_ranked(spark, sf))
    return out.select("category", "n_features", "n_top10", "n_top30", "best_rank",
                      F.round("mean_abs_corr", 6).alias("mean_abs_corr"), F.round("mean_mi", 6).alias("mean_mi"),
                      F.round("mean_f", 4).alias("mean_f"))


@register("sel_11", _with_scores(
    "SELECT feature, " + " + ".join(f"CAST(rank_{m} <= 10 AS INTEGER)" for m in sel.METHODS) + " AS votes FROM rk",
    rk=_ranked_sql()))
def sel_11(spark, sf):
    return sel.agreement(_ranked(spark, sf))


@register("sel_12", _with_scores(
    "SELECT DISTINCT CASE WHEN ra.ensemble_rank > rb.ensemble_rank THEN p.feature_a ELSE p.feature_b END AS feature "
    "FROM red p JOIN rk ra ON p.feature_a = ra.feature JOIN rk rb ON p.feature_b = rb.feature",
    rk=_ranked_sql(), red=_RED))
def sel_12(spark, sf):
    ranked = _ranked(spark, sf)
    return sel.drop_candidates(_redundant(spark, sf, ranked), ranked)


@register("txt_10", _with_scores("SELECT feature, category FROM rk", rk=_ranked_sql()))
def txt_10(spark, sf):
    return _ranked(spark, sf).select("feature", "category")
