"""The deterministic rules of the model lab (TUN-03..05, XPL-03..06, RFN-01/03/05) over inputs that
SQL can compute too.

The ids themselves run on fitted models (``q_ml``), whose numbers have no SQL twin; here the same
operators get importances from the closed-form feature scores, metrics from the rule scorers and
contributions from a fixed linear score, so that DuckDB can check every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators import explain as xp
from roadlens.operators import train as tr
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.q_select import _RESULTS_SQL, LABEL, METRICS, _matrix_sql, _scores, _with_scores, feature_matrix, model_results

# ------------------------------------------------------------------ importances (XPL-06, RFN-01)


def _importances(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _scores(spark, sf)
    return (s.select("feature", F.round("abs_corr", 6).alias("importance")),
            s.select("feature", F.round("mutual_info", 6).alias("mean_abs_shap")),
            s.filter("feature <> 'hour'").select("feature", F.round(F.col("f_score") - 1, 4).alias("perm_mean")))


_INFLUENCE = """SELECT *, rank() OVER (ORDER BY mean_rank) AS composite_rank FROM (
  SELECT *, round_even((rank_mdi + rank_mean_abs_shap + rank_perm) / 3.0, 2) AS mean_rank FROM (
    SELECT *, rank() OVER (ORDER BY mdi DESC) AS rank_mdi, rank() OVER (ORDER BY mean_abs_shap DESC) AS rank_mean_abs_shap,
           rank() OVER (ORDER BY perm DESC) AS rank_perm, count(*) OVER () AS n_features FROM (
      SELECT feature, round(abs_corr, 6) AS mdi, round(mutual_info, 6) AS mean_abs_shap,
             CASE WHEN feature = 'hour' THEN 0.0 ELSE round(f_score - 1, 4) END AS perm FROM sc)))"""


@register("xpl_06_rules", _with_scores(
    "SELECT *, CASE WHEN composite_rank >= n_features * 0.85 THEN 'Least Useful' WHEN composite_rank <= n_features * 0.15 "
    "THEN 'Most Influential' ELSE 'Moderate' END AS influence FROM inf", inf=_INFLUENCE))
def xpl_06_rules(spark, sf):
    return xp.influence_table(*_importances(spark, sf))


@register("rfn_01_rules", _with_scores(
    "SELECT feature, CAST(a + b + c AS INTEGER) AS votes, concat_ws('|', CASE WHEN a = 1 THEN 'low_rank' END, "
    "CASE WHEN b = 1 THEN 'low_shap' END, CASE WHEN c = 1 THEN 'zero_perm' END) AS reasons, a + b + c >= 2 AS drop FROM ("
    "SELECT feature, CAST(row_number() OVER (ORDER BY composite_rank DESC, feature) <= greatest(1, floor(n_features * 0.2)) "
    "AS INTEGER) AS a, CAST(mean_abs_shap < 0.0005 AS INTEGER) AS b, CAST(perm <= 0 AS INTEGER) AS c FROM inf)",
    inf=_INFLUENCE))
def rfn_01_rules(spark, sf):
    return xp.weak_features(xp.influence_table(*_importances(spark, sf)))


# ------------------------------------------------------------------ model metrics (TUN-03..05, RFN-03, RFN-05)

_DIAGNOSIS = """CASE WHEN t > 0.85 AND t - v > 0.10 THEN 'Overfit' WHEN v < 0.60 AND t - v < 0.05 THEN 'Underfit'
  WHEN t - v > 0.06 THEN 'High Variance' WHEN t < 0.70 THEN 'High Bias' ELSE 'Good Fit' END"""
_CURVES_SQL = (f"cu AS (SELECT model, t, v, {_DIAGNOSIS} AS diagnosis FROM (SELECT model, round(accuracy, 6) AS t, "
               "round(auc, 6) AS v FROM res WHERE model <> 'len_8000'))")


def _curve_points(spark, sf) -> DataFrame:
    """Accuracy in the place of the training score, AUC in that of the validation score."""
    return (model_results(spark, sf).filter("model <> 'len_8000'")
            .select("model", F.round("accuracy", 6).alias("t"), F.round("auc", 6).alias("v")))


@register("rfn_03_rules", f"WITH {_RESULTS_SQL}, {_CURVES_SQL} SELECT model, t, v, diagnosis FROM cu")
def rfn_03_rules(spark, sf):
    return _curve_points(spark, sf).withColumn("diagnosis", xp.diagnosis(F.col("t"), F.col("v")))


@register("rfn_05_rules", f"""WITH {_RESULTS_SQL}, {_CURVES_SQL},
w AS (SELECT res.model, 0.35 * auc + 0.30 * f1 + 0.20 * recall + 0.10 * precision + 0.05 * accuracy AS s,
      CAST(CASE WHEN diagnosis IN ('Overfit', 'High Variance') THEN -0.04 WHEN diagnosis = 'Underfit' THEN -0.02 ELSE 0.0 END AS DOUBLE) AS p,
      coalesce(diagnosis, 'N/A') AS diagnosis FROM res LEFT JOIN cu ON res.model = cu.model)
SELECT model, round(s, 6) AS weighted, p AS penalty, round(s + p, 6) AS final_score, diagnosis,
       row_number() OVER (ORDER BY round(s + p, 6) DESC, model) AS rank FROM w""")
def rfn_05_rules(spark, sf):
    results = model_results(spark, sf).select("model", *[F.col(m).alias(f"test_{m}") for m in METRICS])
    return xp.final_selection(results, rfn_03_rules(spark, sf))


def _searches(spark, sf) -> DataFrame:
    """One 'random' and one 'grid' row per model and metric, the metric as objective."""
    r = model_results(spark, sf)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("objective"), F.col(m).alias("value")) for m in METRICS])).alias("c")
    both = F.explode(F.array(F.struct(F.lit("random").alias("search"), F.lit(0.9).alias("f")),
                             F.struct(F.lit("grid").alias("search"), F.lit(1.0).alias("f")))).alias("s")
    long = r.select("model", cells).select("model", "c.objective", "c.value", both)
    return long.select(F.lit("rule").alias("model"), "objective", F.col("model").alias("params"),
                       F.round(F.col("value") * F.col("s.f"), 6).alias("cv_score"), F.col("s.search").alias("search"))


_SEARCH_SQL = f"""se AS (SELECT 'rule' AS model, objective, model AS params, round(value * f, 6) AS cv_score, search FROM
  (UNPIVOT res ON {", ".join(METRICS)} INTO NAME objective VALUE value), (VALUES ('random', 0.9::DOUBLE), ('grid', 1.0::DOUBLE)) s(search, f))"""


@register("tun_03_rules", f"""WITH {_RESULTS_SQL}, {_SEARCH_SQL}
SELECT model, objective, baseline, tuned, round(tuned - baseline, 6) AS delta,
       round((tuned - baseline) / greatest(abs(baseline), 1e-9) * 100, 4) AS pct_change
FROM (SELECT model, objective, max(cv_score) AS tuned, min(cv_score) AS baseline FROM se GROUP BY ALL)""")
def tun_03_rules(spark, sf):
    s = _searches(spark, sf)
    baseline = s.groupBy("model", "objective").agg(F.min("cv_score").alias("baseline"))
    t = tr.improvement_table(s, baseline)
    return t.select("model", "objective", "baseline", "tuned", F.round("delta", 6).alias("delta"),
                    F.round("pct_change", 4).alias("pct_change"))


@register("tun_04_rules", f"""WITH {_RESULTS_SQL}, {_SEARCH_SQL}
SELECT model, objective, cv_score, params, search FROM se
QUALIFY row_number() OVER (PARTITION BY model, objective ORDER BY cv_score DESC, params DESC, search DESC) = 1""")
def tun_04_rules(spark, sf):
    return tr.best_params(_searches(spark, sf))


@register("tun_05_rules", f"""WITH {_RESULTS_SQL}
SELECT model, round(auc, 6) AS cv_auc_mean FROM res ORDER BY auc DESC, model LIMIT 2""")
def tun_05_rules(spark, sf):
    r = model_results(spark, sf).select("model", F.round("auc", 6).alias("cv_auc_mean"))
    return tr.top_models(r, 2)


# ------------------------------------------------------------------ linear contributions (XPL-03..05)

WEIGHTS = {"cause_severity_score": 0.8, "hour": -0.05, "dist_to_city_centre": 0.02, "num_lanes": 0.3, "is_weekend": -0.4,
           "veh_type_risk_score": 1.5}
BASE = -0.25


def _contributions(spark, sf) -> DataFrame:
    """(id, feature, shap): fixed weight x distance from the feature's mean over the training rows."""
    fm = feature_matrix(spark, sf)
    mean = fm.filter(F.col("id") % 5 != 0).agg(*[F.round(F.avg(f), 6).alias(f) for f in WEIGHTS]).first()
    terms = F.array(*[F.struct(F.lit(f).alias("feature"), F.round((F.col(f) - F.lit(mean[f])) * F.lit(w), 6).alias("shap"))
                      for f, w in WEIGHTS.items()])
    return fm.select("id", F.explode(terms).alias("t")).select("id", "t.feature", "t.shap")


_CONTRIB = " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, round((CAST({f} AS DOUBLE) - (SELECT round(avg({f}), 6) FROM fm WHERE id % 5 <> 0)) * {O.d(w)}, 6) "
    "AS shap FROM fm" for f, w in WEIGHTS.items())


@register("xpl_03_rules", O.with_ctes(
    "SELECT feature, round(m, 6) AS mean_abs_shap, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM "
    "(SELECT feature, avg(abs(shap)) AS m FROM c GROUP BY feature)", fm=_matrix_sql(), c=_CONTRIB))
def xpl_03_rules(spark, sf):
    t = xp.mean_abs_shap(_contributions(spark, sf))
    return t.select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), "rank")


@register("xpl_05_rules", O.with_ctes(
    f"SELECT id, feature, shap, rank, round(total, 4) AS predicted_logit FROM (SELECT *, {O.d(BASE)} + sum(shap) OVER (PARTITION BY id) "
    "AS total, row_number() OVER (PARTITION BY id ORDER BY abs(shap) DESC, feature) AS rank FROM c) WHERE rank <= 5",
    fm=_matrix_sql(), c=_CONTRIB))
def xpl_05_rules(spark, sf):
    t = xp.additive_explanation(_contributions(spark, sf), BASE)
    return t.withColumn("predicted_logit", F.round("predicted_logit", 4))


@register("xpl_04_rules", O.with_ctes(
    "SELECT \"case\", arg_max(id, k) AS id, round(any_value(best), 6) AS score FROM (SELECT *, first_value(s) OVER w AS best, "
    "row_number() OVER w AS r, -row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY \"case\" ORDER BY "
    "CASE WHEN \"case\" IN ('TP', 'FP') THEN -s ELSE s END, CASE WHEN \"case\" IN ('TP', 'FP') THEN -id ELSE id END)) "
    "GROUP BY \"case\"", fm=_matrix_sql(), c=_CONTRIB,
    q=f"SELECT id, round({O.d(BASE)} + sum(shap), 4) AS s FROM c GROUP BY id",
    p=f"SELECT q.id, s, CASE WHEN {LABEL} = 1 THEN CASE WHEN s >= 0 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN s >= 0 THEN 'FP' "
      "ELSE 'TN' END END AS \"case\" FROM q JOIN fm ON q.id = fm.id"))
def xpl_04_rules(spark, sf):
    total = _contributions(spark, sf).groupBy("id").agg(F.round(F.lit(BASE) + F.sum("shap"), 4).alias("score"))
    pred = total.join(feature_matrix(spark, sf).select("id", F.col(LABEL).alias("label")), "id") \
        .withColumn("pred", (F.col("score") >= 0).cast("int"))
    return xp.pick_cases(pred)
