"""DuckDB-side building blocks for the oracle SQL (independent of the Spark code)."""

from __future__ import annotations

from roadlens.sources.tables import (
    BIND_CAUSES, BIND_CORRIDORS, BIND_DESCRIPTIONS, BIND_GBA, BIND_STREETS, BIND_VEHICLES,
    BIND_ZONES,
)


def q(s) -> str:
    if isinstance(s, (int, float)) and not isinstance(s, bool):
        return repr(s)
    return "'" + s.replace("'", "''") + "'"


def case_pick(idx: str, values: list) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


INCIDENTS_SQL = f"""
SELECT
  event_id AS id,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 71 = 0 THEN 'not a timestamp' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS start_datetime,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE make_timestamp(epoch_us(ts) + ((event_id % 240) - 30) * 60000000) END AS created_ts,
  CAST(12.80 AS DOUBLE) + CAST((event_id * 7919) % 4700 AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS latitude,
  CAST(77.31 AS DOUBLE) + CAST((event_id * 6101) % 4600 AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS longitude,
  {case_pick('(event_id * 31 + user_id) % 17', BIND_CAUSES)} AS event_cause,
  CASE WHEN event_id % 17 = 0 THEN 'planned' ELSE 'unplanned' END AS event_type,
  CASE WHEN event_id % 3 = 0 THEN 'no' ELSE 'yes' END AS authenticated,
  CASE WHEN event_id % 5 < 2 THEN NULL ELSE {case_pick('user_id % 10', BIND_VEHICLES)} END AS veh_type,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE {case_pick('user_id % 18', BIND_CORRIDORS)} END AS corridor,
  'PS' || CAST(user_id % 54 AS VARCHAR) AS police_station,
  CASE WHEN event_id % 7 < 4 THEN NULL ELSE {case_pick('user_id % 10', BIND_ZONES)} END AS zone,
  CASE WHEN event_id % 7 < 4 THEN NULL ELSE {case_pick('user_id % 5', BIND_GBA)} END AS gba_identifier,
  CASE WHEN event_id % 10 < 7 THEN NULL ELSE 'J' || CAST((user_id * 7 + event_id) % 294 AS VARCHAR) END AS junction,
  CASE WHEN event_id % 6 = 5 THEN NULL ELSE {case_pick('(event_id * 13 + user_id) % 8', BIND_DESCRIPTIONS)} END AS description,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE
    'No ' || CAST(event_id % 300 AS VARCHAR) || ', ' || {case_pick('user_id % 4', BIND_STREETS)}
    || CASE WHEN event_id % 3 = 0 THEN ', Bengaluru Pin-5600' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') ELSE '' END
  END AS address,
  CASE WHEN (event_type = 'error' AND value > 90) OR value > 150 THEN 1 ELSE 0 END AS requires_road_closure,
  CASE WHEN event_id % 13 < 8 THEN 'High' ELSE 'Low' END AS priority,
  value AS duration_mins,
  CAST(1 + event_id % 4 AS INTEGER) AS num_lanes,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'DISPATCHED'
       WHEN 'error' THEN 'ON_SCENE' ELSE 'RESOLVED' END AS status,
  event_id % 5 <> 0 AS is_train
FROM events
"""

SCORED_LABELS_SQL = """
SELECT l.doc_id AS id, l.quality AS label,
       CAST(d.n_chars AS DOUBLE) / (d.n_chars + CAST(2000.0 AS DOUBLE)) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH incidents AS (...), <ctes> <body>`` — incidents always first."""
    parts = [f"incidents AS ({INCIDENTS_SQL})"] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---- DuckDB expression helpers (mirror roadlens.functions, written in SQL) ----------

def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def dmap(expr: str, mapping: dict, default) -> str:
    """Literal map lookup; string or numeric values; ELSE default."""
    def lit(v):
        if isinstance(v, str):
            return q(v)
        return d(float(v))
    whens = " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {lit(default) if default is not None else 'NULL'} END)"


def rnd(expr: str, digits: int) -> str:
    """numpy-style half-even rounding."""
    return f"round_even({expr}, {digits})"


def hav(lat: str, lon: str, lat2, lon2) -> str:
    """Haversine km, R = 6371, asin argument clamped to 1."""
    def v(x):
        return d(float(x)) if isinstance(x, (int, float)) else x
    la1, lo1, la2, lo2 = (f"radians({v(x)})" for x in (lat, lon, lat2, lon2))
    a = f"(pow(sin(({la2} - {la1}) / 2), 2) + cos({la1}) * cos({la2}) * pow(sin(({lo2} - {lo1}) / 2), 2))"
    return f"({d(2 * 6371.0)} * asin(least({d(1.0)}, sqrt({a}))))"


def flag(cond: str) -> str:
    return f"(CASE WHEN coalesce({cond}, false) THEN 1 ELSE 0 END)"


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def hour_bin_code_sql(h: str) -> str:
    return (f"(CASE WHEN {h} BETWEEN 0 AND 3 THEN 0 WHEN {h} BETWEEN 4 AND 7 THEN 1 WHEN {h} BETWEEN 8 AND 13 THEN 2 "
            f"WHEN {h} BETWEEN 14 AND 18 THEN 3 WHEN {h} BETWEEN 19 AND 23 THEN 4 ELSE -1 END)")


# Stage-2 context: imputed categoricals + hour + hour bin code.
PREP_SQL = f"""
SELECT * REPLACE (
         coalesce(veh_type, 'unknown_vehicle') AS veh_type,
         coalesce(gba_identifier, 'unknown_gba') AS gba_identifier,
         coalesce(zone, 'unknown_zone') AS zone,
         coalesce(junction, 'unknown_junction') AS junction,
         coalesce(corridor, 'unknown_corridor') AS corridor,
         coalesce(police_station, 'unknown_police_station') AS police_station),
       coalesce(hour(ts), -1) AS hour,
       {hour_bin_code_sql('coalesce(hour(ts), -1)')} AS hour_bin_code
FROM incidents
"""


def with_prep(body: str, **ctes: str) -> str:
    """incidents -> prep -> tr (training rows) -> g (prior) -> caller CTEs."""
    return with_ctes(body, prep=PREP_SQL, tr="SELECT * FROM prep WHERE is_train",
                     g="SELECT avg(CAST(requires_road_closure AS DOUBLE)) AS gm FROM tr", **ctes)


def rate_cte(keys: list[str], target: str = "requires_road_closure", src: str = "tr") -> str:
    cond = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    ks = ", ".join(keys)
    return f"SELECT {ks}, count(*) AS n, avg(CAST({target} AS DOUBLE)) AS m FROM {src} WHERE {cond} GROUP BY {ks}"


def smoothed(alias: str, alpha: float, min_count: int = 0, prior: str = "g.gm") -> str:
    sm = f"(({alias}.n * {alias}.m + {d(float(alpha))} * {prior}) / ({alias}.n + {d(float(alpha))}))"
    if min_count:
        sm = f"(CASE WHEN {alias}.n < {min_count} THEN {prior} ELSE {sm} END)"
    return f"coalesce({sm}, {prior})"


def join_on(alias: str, keys: list[str], left: str = "p") -> str:
    return " AND ".join(f"{left}.{k} = {alias}.{k}" for k in keys)
