"""Fit/transform operators: imputers, fences, scalers, encoders, group rates,
rolling counts, interactions, splits (IMP, OUT, SCL, ENC, GRP, ROL, INT, SPL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import encode, impute, rates, rolling
from roadlens.operators import features as feat
from roadlens.operators.outliers import FenceModel, MinMaxModel, StandardScalerModel, iqr_fences
from roadlens.operators.prefix import chronological_split, hash_sample, stratified_folds
from roadlens.plans import oracle_base as O
from roadlens.plans.catalog import register
from roadlens.plans.stage2 import STAGE2_SQL, assemble, INTERACTION_COLS
from roadlens.sources.tables import incidents, read_table

T = "requires_road_closure"
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["corridor", "zone", "veh_type", "police_station"]


def _ctx(spark, sf):
    ctx = feat.prepare_context(incidents(spark, sf))
    tr = ctx.filter(F.col("is_train"))
    return ctx, tr, rates.global_mean(tr, T)


# ------------------------------------------------------------------ imputation

@register("imp_01", O.with_ctes("""
SELECT id, coalesce(hr, med.mh) AS hr, coalesce(lag_min, med.ml) AS lag_min,
       CAST(hr IS NULL AS INTEGER) AS hr_was_missing, CAST(lag_min IS NULL AS INTEGER) AS lag_min_was_missing
FROM base, med""",
    base="SELECT id, is_train, hour(ts) AS hr, CAST(epoch_us(created_ts) - epoch_us(ts) AS DOUBLE) / 6e7 AS lag_min "
         "FROM incidents",
    med="SELECT quantile_cont(hr, 0.5) AS mh, quantile_cont(lag_min, 0.5) AS ml FROM base WHERE is_train"))
def imp_01(spark, sf):
    inc = incidents(spark, sf)
    base = inc.select("id", "is_train", F.hour("ts").alias("hr"),
                      ((F.unix_micros("created_ts") - F.unix_micros("ts")).cast("double") / F.lit(6e7)).alias("lag_min"))
    model = impute.fit_median_imputer(base.filter("is_train"), ["hr", "lag_min"])
    return model.transform(base.select("id", "hr", "lag_min"))


def _mode_sql(c):
    return (f"(SELECT {c} FROM incidents WHERE is_train AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("imp_03", O.with_ctes(
    f"SELECT id, coalesce(corridor, {_mode_sql('corridor')}) AS corridor, "
    f"coalesce(police_station, {_mode_sql('police_station')}) AS police_station FROM incidents"))
def imp_03(spark, sf):
    inc = incidents(spark, sf).select("id", "corridor", "police_station", "is_train")
    modes = impute.fit_mode(inc.filter("is_train"), ["corridor", "police_station"])
    return impute.mode_impute(inc.select("id", "corridor", "police_station"), modes)


_AUDIT_COLS = ["veh_type", "corridor", "zone", "gba_identifier", "junction", "description"]


@register("imp_05", O.with_ctes(" UNION ALL ".join(
    f"SELECT {O.q(c)} AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing_before, 0 AS missing_after, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS resolved FROM incidents" for c in _AUDIT_COLS)))
def imp_05(spark, sf):
    before = incidents(spark, sf).select(*_AUDIT_COLS)
    after = impute.text_impute(impute.constant_impute(before, _AUDIT_COLS[:-1], add_indicator=False), ["description"])
    return impute.missing_audit(before, after)


_DTYPES = [("bigint", 1), ("boolean", 1), ("double", 3), ("int", 2), ("string", 14), ("timestamp", 2)]


@register("imp_06", O.with_ctes(
    "SELECT s.rows, 23 AS columns, t.dtype, t.n_columns, s.null_cells FROM "
    "(SELECT count(*) AS rows, CAST(sum(" + " + ".join(
        f"CAST({c} IS NULL AS BIGINT)" for c in [
            "id", "ts", "start_datetime", "created_ts", "latitude", "longitude", "event_cause", "event_type",
            "authenticated", "veh_type", "corridor", "police_station", "zone", "gba_identifier", "junction",
            "description", "address", "requires_road_closure", "priority", "duration_mins", "num_lanes", "status",
            "is_train"]) + ") AS BIGINT) AS null_cells FROM incidents) s, (VALUES " +
    ", ".join(f"('{d}', {n})" for d, n in _DTYPES) + ") AS t(dtype, n_columns)"))
def imp_06(spark, sf):
    return impute.feature_summary(incidents(spark, sf))


# ------------------------------------------------------------------ outliers / scaling (lineitem scale)

def _q_sql(c):
    return (f"SELECT {O.q(c)} AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
            f"FROM lineitem WHERE {c} IS NOT NULL")


_FENCES_SQL = (" UNION ALL ".join(_q_sql(c) for c in LI_COLS))


@register("out_01", f"""SELECT "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM ({_FENCES_SQL})""")
def out_01(spark, sf):
    return iqr_fences(read_table(spark, sf, "lineitem"), LI_COLS)


def _fence_cols_sql(kind):
    parts = []
    for c in LI_COLS:
        lo = f"(SELECT q1 - 1.5 * (q3 - q1) FROM f WHERE \"column\" = {O.q(c)})"
        hi = f"(SELECT q3 + 1.5 * (q3 - q1) FROM f WHERE \"column\" = {O.q(c)})"
        if kind == "flag":
            parts.append(f"CAST(coalesce({c} < {lo} OR {c} > {hi}, false) AS INTEGER) AS {c}_iqr_outlier")
        else:
            parts.append(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END AS {c}")
    return ", ".join(parts)


@register("out_02", f"WITH f AS ({_FENCES_SQL}) SELECT l_orderkey, l_linenumber, {_fence_cols_sql('flag')} FROM lineitem")
def out_02(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_COLS)
    return FenceModel.fit(li, LI_COLS).flags(li).drop(*LI_COLS)


@register("out_03", f"WITH f AS ({_FENCES_SQL}) SELECT l_orderkey, l_linenumber, {_fence_cols_sql('clip')} FROM lineitem")
def out_03(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_COLS)
    return FenceModel.fit(li, LI_COLS).winsorise(li)


@register("scl_01", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM lineitem)) / coalesce(nullif((SELECT stddev_pop({c}) FROM lineitem), 0), 1) AS {c}"
    for c in LI_COLS) + " FROM lineitem")
def scl_01(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_COLS)
    return StandardScalerModel.fit(li, LI_COLS).transform(li)


@register("scl_02", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) AS {c}"
    for c in LI_COLS) + " FROM lineitem")
def scl_02(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_COLS)
    return MinMaxModel.fit(li, LI_COLS).transform(li)


# ------------------------------------------------------------------ encoders

@register("enc_01", O.with_prep(
    "SELECT p.id, " + ", ".join(f"coalesce(l_{c}.code, -1) AS {c}_label" for c in CATS) + " FROM prep p " +
    " ".join(f"LEFT JOIN l_{c} ON p.{c} = l_{c}.value" for c in CATS),
    **{f"l_{c}": f"SELECT {c} AS value, dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM tr "
                 f"WHERE {c} IS NOT NULL)" for c in CATS}))
def enc_01(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    out = encode.label_encode(ctx.select("id", *CATS), tr, CATS)
    return out.select("id", *[f"{c}_label" for c in CATS])


@register("enc_02", O.with_prep(
    "SELECT p.id, " + ", ".join(f"coalesce(f_{c}.s, 0.0) AS {c}_freq" for c in CATS) + " FROM prep p " +
    " ".join(f"LEFT JOIN f_{c} ON p.{c} = f_{c}.{c}" for c in CATS),
    **{f"f_{c}": f"SELECT {c}, count(*) / (SELECT count({c}) FROM tr) AS s FROM tr WHERE {c} IS NOT NULL GROUP BY {c}"
       for c in CATS}))
def enc_02(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return encode.frequency_encode(ctx.select("id", *CATS), tr, CATS).select("id", *[f"{c}_freq" for c in CATS])


@register("enc_03", O.with_prep(
    "SELECT p.id, " + ", ".join(f"{O.smoothed('t_' + c, 10)} AS {c}_te" for c in CATS) + " FROM prep p CROSS JOIN g " +
    " ".join(f"LEFT JOIN t_{c} ON p.{c} = t_{c}.{c}" for c in CATS),
    **{f"t_{c}": O.rate_cte([c]) for c in CATS}))
def enc_03(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return encode.target_encode(ctx.select("id", *CATS), tr, CATS, T, prior=g).select("id", *[f"{c}_te" for c in CATS])


@register("enc_04", O.with_prep("""
SELECT feature, category, count, dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS label_code,
       count / sum(count) OVER (PARTITION BY feature) AS frequency_code,
       (count * target_mean + 10.0 * (SELECT gm FROM g)) / (count + 10.0) AS target_code, target_mean
FROM (SELECT feature, category, count(*) AS count, avg(CAST(y AS DOUBLE)) AS target_mean FROM (
""" + " UNION ALL ".join(f"SELECT {O.q(c)} AS feature, {c} AS category, requires_road_closure AS y FROM tr" for c in CATS)
    + ") WHERE category IS NOT NULL GROUP BY feature, category)"))
def enc_04(spark, sf):
    _, tr, _ = _ctx(spark, sf)
    return encode.encoder_comparison(tr, CATS, T)


# ------------------------------------------------------------------ group rates (GRP-01..13)

def _rate_sql(keys, out, alpha, min_count=0, digits=4, extra_join=""):
    alias = "t"
    v = O.smoothed(alias, alpha, min_count)
    v = O.rnd(v, digits) if digits is not None else v
    return O.with_prep(f"SELECT p.id, {v} AS {out} FROM prep p CROSS JOIN g LEFT JOIN t ON {O.join_on('t', keys)}",
                       t=O.rate_cte(keys))


@register("grp_01", _rate_sql(["corridor"], "corridor_risk_score", 20, 20))
def grp_01(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.corridor_risk(ctx.select("id", "corridor"), tr, T, g).select("id", "corridor_risk_score")


@register("grp_02", O.with_prep(
    "SELECT p.id, round_even(coalesce(t.n / (SELECT count(*) FROM tr), 0.0), 5) AS corridor_event_density "
    "FROM prep p LEFT JOIN t ON p.corridor = t.corridor",
    t="SELECT corridor, count(*) AS n FROM tr WHERE corridor IS NOT NULL GROUP BY corridor"))
def grp_02(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return feat.corridor_density(ctx.select("id", "corridor"), tr).select("id", "corridor_event_density")


@register("grp_03", O.with_prep(
    "SELECT p.id, coalesce(t.n / (SELECT count(*) FROM tr), 0.0) AS hour_corridor_density "
    "FROM prep p LEFT JOIN t ON p.corridor = t.corridor AND p.hour_bin_code = t.hour_bin_code",
    t="SELECT corridor, hour_bin_code, count(*) AS n FROM tr GROUP BY ALL"))
def grp_03(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return feat.hour_corridor_density(ctx.select("id", "corridor", "hour_bin_code"), tr).select(
        "id", "hour_corridor_density")


@register("grp_04", O.with_prep(
    "SELECT p.id, round_even(coalesce(t.n / (SELECT count(*) FROM tr), 0.2), 5) AS hour_bin_system_load "
    "FROM prep p LEFT JOIN t ON p.hour_bin_code = t.hour_bin_code",
    t="SELECT hour_bin_code, count(*) AS n FROM tr GROUP BY ALL"))
def grp_04(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return feat.hour_bin_load(ctx.select("id", "hour_bin_code"), tr).select("id", "hour_bin_system_load")


@register("grp_05", _rate_sql(["police_station"], "police_station_risk", 10))
def grp_05(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.police_risk(ctx.select("id", "police_station"), tr, T, g).select("id", "police_station_risk")


@register("grp_06", O.with_prep(
    "SELECT p.id, round_even(coalesce(t.m, 0.5), 4) AS vehicles_per_corridor FROM prep p LEFT JOIN t "
    "ON p.corridor = t.corridor",
    t="SELECT corridor, avg(CASE WHEN event_cause = 'vehicle_breakdown' THEN 1.0 ELSE 0.0 END) AS m FROM tr "
      "WHERE corridor IS NOT NULL GROUP BY corridor"))
def grp_06(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return feat.corridor_vehicle_share(ctx.select("id", "corridor"), tr).select("id", "vehicles_per_corridor")


@register("grp_07", O.with_prep(
    f"SELECT id, zr AS zone_risk_score, zd AS zone_event_density, CAST(zr >= 0.10 AS INTEGER) AS is_high_risk_zone FROM "
    f"(SELECT p.id, round_even({O.smoothed('t', 10)}, 4) AS zr, round_even(coalesce(d.n / (SELECT count(zone) FROM tr), 0.0), 5) AS zd "
    f"FROM prep p CROSS JOIN g LEFT JOIN t ON p.zone = t.zone LEFT JOIN d ON p.zone = d.zone)",
    t=O.rate_cte(["zone"]), d="SELECT zone, count(*) AS n FROM tr WHERE zone IS NOT NULL GROUP BY zone"))
def grp_07(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.zone_features(ctx.select("id", "zone"), tr, T, g).select(
        "id", "zone_risk_score", "zone_event_density", "is_high_risk_zone")


@register("grp_08", _rate_sql(["gba_identifier"], "gba_risk_score", 10))
def grp_08(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.gba_risk(ctx.select("id", "gba_identifier"), tr, T, g).select("id", "gba_risk_score")


_JUNC_SQL = dict(t=O.rate_cte(["junction"]),
                 r="SELECT junction, row_number() OVER (ORDER BY n DESC, junction) AS rk FROM "
                   "(SELECT junction, count(*) AS n FROM tr WHERE junction IS NOT NULL GROUP BY junction)")


@register("grp_09", O.with_prep(
    f"SELECT id, jr AS junction_closure_rate, jc AS junction_event_count, round_even(1.0 - jr, 4) AS junction_safety_index "
    f"FROM (SELECT p.id, round_even({O.smoothed('t', 10, 10)}, 4) AS jr, CAST(coalesce(t.n, 0) AS INTEGER) AS jc "
    f"FROM prep p CROSS JOIN g LEFT JOIN t ON p.junction = t.junction)", **_JUNC_SQL))
def grp_09(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.junction_features(ctx.select("id", "junction"), tr, T, g).select(
        "id", "junction_closure_rate", "junction_event_count", "junction_safety_index")


@register("grp_10", O.with_prep(
    "SELECT p.id, CAST(coalesce(r.rk, 999) AS INTEGER) AS junction_hotspot_rank FROM prep p LEFT JOIN r "
    "ON p.junction = r.junction", **_JUNC_SQL))
def grp_10(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    return feat.junction_features(ctx.select("id", "junction"), tr, T, g).select("id", "junction_hotspot_rank")


@register("grp_11", O.with_prep(
    "SELECT p.id, round_even(coalesce(t.m, g.gm), 4) AS hour_closure_risk FROM prep p CROSS JOIN g "
    "LEFT JOIN t ON p.hour = t.hour", t=O.rate_cte(["hour"])))
def grp_11(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    out = feat.hour_rate(ctx.select("id", "hour"), tr, T, g, rounded=True)
    return out.select("id", F.col("hour_closure_rate_raw").alias("hour_closure_risk"))


@register("grp_12", O.with_prep(
    f"SELECT p.id, round_even({O.smoothed('z', 10, prior='(SELECT avg(CASE WHEN priority = ' + chr(39) + 'High' + chr(39) + ' THEN 1.0 ELSE 0.0 END) FROM tr)')}, 4) "
    f"AS zone_priority_rate, round_even({O.smoothed('j', 10, prior='(SELECT avg(CASE WHEN priority = ' + chr(39) + 'High' + chr(39) + ' THEN 1.0 ELSE 0.0 END) FROM tr)')}, 4) "
    "AS junction_priority_rate FROM prep p LEFT JOIN z ON p.zone = z.zone LEFT JOIN j ON p.junction = j.junction",
    z="SELECT zone, count(*) AS n, avg(CASE WHEN priority = 'High' THEN 1.0 ELSE 0.0 END) AS m FROM tr GROUP BY zone",
    j="SELECT junction, count(*) AS n, avg(CASE WHEN priority = 'High' THEN 1.0 ELSE 0.0 END) AS m FROM tr GROUP BY junction"))
def grp_12(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    pr = tr.agg(F.avg((F.col("priority") == "High").cast("double")).alias("m")).first()["m"]
    return feat.priority_rates(ctx.select("id", "zone", "junction", "priority"), tr, pr, pr).select(
        "id", "zone_priority_rate", "junction_priority_rate")


@register("grp_13", O.with_prep(
    "SELECT p.id, " + ", ".join(f"{O.smoothed(f't{i}', 10, 5)} AS {name}" for i, (_, name) in enumerate(feat.PAIR_RATES))
    + " FROM prep p CROSS JOIN g " + " ".join(f"LEFT JOIN t{i} ON {O.join_on(f't{i}', keys)}"
                                            for i, (keys, _) in enumerate(feat.PAIR_RATES)),
    **{f"t{i}": O.rate_cte(keys) for i, (keys, _) in enumerate(feat.PAIR_RATES)}))
def grp_13(spark, sf):
    ctx, tr, g = _ctx(spark, sf)
    cols = sorted({k for keys, _ in feat.PAIR_RATES for k in keys})
    out = feat.pair_rates(ctx.select("id", *cols), tr, T, g)
    return out.select("id", *[n for _, n in feat.PAIR_RATES])


# ------------------------------------------------------------------ rolling (ROL-01..04)

def _roll_sql(hours, by=()):
    cond = " AND ".join([f"t.{b} = p.{b}" for b in by] + [
        f"epoch_us(t.ts) >= epoch_us(p.ts) - {hours * 3600 * 1000000}", "epoch_us(t.ts) < epoch_us(p.ts)"])
    return f"(SELECT count(*) FROM tr t WHERE {cond})"


@register("rol_01", O.with_prep(
    f"SELECT p.id, CASE WHEN p.ts IS NULL THEN 0 ELSE {_roll_sql(3)} END AS rolling_3h_system_count, "
    f"CASE WHEN p.ts IS NULL THEN 0 ELSE {_roll_sql(6)} END AS rolling_6h_system_count FROM prep p"))
def rol_01(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    df = rolling.window_counts(ctx.select("id", "ts"), tr, [3, 6])
    return df.select("id", "rolling_3h_system_count", "rolling_6h_system_count")


@register("rol_02", O.with_prep(
    f"SELECT p.id, CASE WHEN p.ts IS NULL THEN 0 ELSE {_roll_sql(3, ['corridor'])} END AS rolling_3h_corridor_count "
    "FROM prep p"))
def rol_02(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    df = rolling.window_counts(ctx.select("id", "ts", "corridor"), tr, 3, by=["corridor"],
                               out="rolling_3h_corridor_count")
    return df.select("id", "rolling_3h_corridor_count")


@register("rol_03", O.with_prep(
    "SELECT p.id, coalesce(t.n, 0) AS events_same_day FROM prep p LEFT JOIN t ON CAST(p.ts AS DATE) = t.d",
    t="SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM tr WHERE ts IS NOT NULL GROUP BY 1"))
def rol_03(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return rolling.same_day_counts(ctx.select("id", "ts"), tr).select("id", "events_same_day")


@register("rol_04", O.with_prep(
    "SELECT p.id, coalesce(t.n, 0) AS events_same_zone_day FROM prep p LEFT JOIN t ON CAST(p.ts AS DATE) = t.d "
    "AND p.zone = t.zone",
    t="SELECT zone, CAST(ts AS DATE) AS d, count(*) AS n FROM tr WHERE ts IS NOT NULL GROUP BY 1, 2"))
def rol_04(spark, sf):
    ctx, tr, _ = _ctx(spark, sf)
    return rolling.same_day_counts(ctx.select("id", "ts", "zone"), tr, by=["zone"],
                                   out="events_same_zone_day").select("id", "events_same_zone_day")


# ------------------------------------------------------------------ interactions / assembly

@register("int_01", STAGE2_SQL("SELECT id, " + ", ".join(INTERACTION_COLS) + " FROM s2"))
def int_01(spark, sf):
    return assemble(spark, sf).select("id", *INTERACTION_COLS)


@register("int_02", STAGE2_SQL("SELECT id, hour_closure_risk, closure_risk_composite FROM s2"))
def int_02(spark, sf):
    return assemble(spark, sf).select("id", "hour_closure_risk", "closure_risk_composite")


@register("int_03", STAGE2_SQL("SELECT * EXCLUDE (_g) FROM s2"))
def int_03(spark, sf):
    return assemble(spark, sf)


# ------------------------------------------------------------------ splits

@register("spl_01", O.with_ctes(
    "SELECT id, pos, CASE WHEN pos < CAST(floor((SELECT count(*) FROM incidents) * 0.8) AS BIGINT) THEN 'train' "
    "ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY ts IS NULL, ts, id) - 1 AS pos FROM incidents)"))
def spl_01(spark, sf):
    return chronological_split(incidents(spark, sf).select("id", "ts"), "ts", "id").select("id", "pos", "split")


_MIX = "((id % 4294967296) * 40503 + 42 * 7919) % 4294967296"


@register("spl_02", O.with_ctes(
    "SELECT id, requires_road_closure, CAST((row_number() OVER (PARTITION BY requires_road_closure "
    f"ORDER BY {_MIX}, id) - 1) % 5 AS INTEGER) AS fold FROM incidents"))
def spl_02(spark, sf):
    df = incidents(spark, sf).select("id", "requires_road_closure")
    return stratified_folds(df, "requires_road_closure", "id").select("id", "requires_road_closure", "fold")


@register("spl_03", O.with_ctes(f"SELECT id, event_cause, requires_road_closure FROM incidents ORDER BY {_MIX}, id LIMIT 500"))
def spl_03(spark, sf):
    return hash_sample(incidents(spark, sf).select("id", "event_cause", "requires_road_closure"), "id", 500)

