"""Driver queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.queries import query, table


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string: bit by bit over its characters, each followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, e: "
            "CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")


# ------------------------------------------------------------------ 11

def _step_sql() -> str:
    """The next state of the recursion: a struct (k: cost and audit, t: repaired lines) per grammar state."""
    add = lambda s, cost, letter, line=None: (
        f"CASE WHEN {s} IS NOT NULL THEN {{'k': printf('%09d', CAST({s}.k[1:9] AS INT) + {cost}) || {s}.k[10:] || '{letter}', "
        f"'t': " + (f"list_append({s}.t, {line})" if line else f"{s}.t") + "} END")
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda y: y IS NOT NULL))"
    inserted = {0: "i0", 1: "i1", 2: "i2", 3: "i3"}
    more = "(CASE WHEN r.fault = 3 THEN 3 ELSE 0 END)"
    stays = "r.fault NOT IN (1, 2)"
    own, user, bot = "r.role || ':' || r.text", "'user:' || r.text", "'assistant:' || r.text"
    def if_(test: str, x: str) -> str:
        return f"CASE WHEN {stays} AND {test} THEN {x} END"
    to = {0: [], 1: [if_("r.c = 's'", add("i0", more, "K", own))], 2: [], 3: []}
    for q, s in inserted.items():
        to[q].append(add(s, 4, "D"))
        goal, line = (3, bot) if q == 2 else (2, user)
        to[goal].append(if_("true", add(s, f"3 + {more}", "R", line)))
    to[2] += [if_("r.c = 'u'", add(inserted[q], more, "K", own)) for q in (0, 1, 3)]
    to[3].append(if_("r.c = 'a'", add("i2", more, "K", own)))
    return ", ".join(f"{least(*to[q])} AS s{q}" for q in range(4))


def _inserts_sql(source: str) -> str:
    """Columns i0 .. i3: the states after any inserts (at most two are ever of use)."""
    add = lambda s, line: (f"CASE WHEN {s} IS NOT NULL THEN {{'k': printf('%09d', CAST({s}.k[1:9] AS INT) + 3) || {s}.k[10:] || 'I', "  # noqa: E731
                           f"'t': list_append({s}.t, '{line}:')}} END")
    least = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda y: y IS NOT NULL))"
    a = f"(SELECT *, {least('s2', add('s0', 'user'), add('s1', 'user'), add('s3', 'user'))} AS j2 FROM {source})"
    b = f"(SELECT *, {least('s3', add('j2', 'assistant'))} AS i3 FROM {a})"
    return f"(SELECT *, s0 AS i0, s1 AS i1, {least('j2', add('i3', 'user'))} AS i2 FROM {b})"


OP11_SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM dam),
f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS c,
  CASE WHEN x = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
       WHEN right(x, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS s1,
    CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS s2, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS s3 FROM n
  UNION ALL
  SELECT w.conv_id, r.i, {_step_sql()} FROM {_inserts_sql('walk')} w JOIN f r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
e AS (SELECT w.conv_id, list_min(list_filter([i0, i3], lambda y: y IS NOT NULL)) AS z FROM {_inserts_sql('walk')} w
  JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(z.k[1:9] AS INT), 0) AS BIGINT) AS cost,
  coalesce(z.k[10:], '') AS audit, sha256(coalesce(array_to_string(z.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that the query plants."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                         (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("d")).where("d <> 0")
    return marked.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                         F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                         F.explode(F.array_repeat(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.chat_repair import report
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


# ------------------------------------------------------------------ 12

OP12_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x00-\x20]')) + 4 AS cost,
  14 + length(role) + len(regexp_extract_all(role, '[\\<>]')) + length(regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g')) + 1 AS chars FROM c),
p AS (SELECT *, row_number() OVER w - 1 AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, (upto - 1) // 512 AS cell FROM p),
q AS (SELECT *, CASE WHEN sum(cost) OVER (PARTITION BY conv_id, cell) > 512 AND upto - cost < cell * 512 THEN 0 ELSE 1 END AS part FROM s),
w AS (SELECT conv_id, cell, part, min(rank) AS first, min(upto - cost) AS start, sum(cost) AS fresh FROM q GROUP BY ALL),
m AS (SELECT conv_id, cost, chars FROM q WHERE rank = 0 AND role = 'system'),
x AS (SELECT w.*, m.chars AS system_chars, least(256, 1024 - fresh - coalesce(m.cost, 0)) AS room FROM w
  LEFT JOIN m ON w.conv_id IS NOT DISTINCT FROM m.conv_id WHERE first > 0),
h AS (SELECT x.conv_id, sum(q.chars) AS chars FROM x JOIN q ON x.conv_id IS NOT DISTINCT FROM q.conv_id AND q.rank BETWEEN first - 4 AND first - 1
  WHERE start - (upto - cost) <= room AND NOT (rank = 0 AND system_chars IS NOT NULL) GROUP BY 1),
y AS (SELECT conv_id, sum(coalesce(system_chars, 0)) AS chars FROM x GROUP BY 1),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank) AS turns,
  coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS learnt, sum(chars) AS chars FROM q GROUP BY 1)
SELECT a.conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(a.chars + coalesce(h.chars, 0) + coalesce(y.chars, 0) AS BIGINT) AS formatted_chars
FROM a LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN y ON a.conv_id IS NOT DISTINCT FROM y.conv_id
"""


@query("op12_chat_formatting", OP12_SQL)
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.chat_format import digests, format_windows
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digests(format_windows(rows.unionByName(more)))


# ------------------------------------------------------------------ 13

TREE_LEVELS = 16       # of the SQL only: 3 ** 16 leaves in a group


def _levels_sql(name: str) -> str:
    """Columns l0 .. l16 over a table with the list l0."""
    out = name
    for k in range(TREE_LEVELS):
        out = (f"(SELECT *, CASE WHEN len(l{k}) > 1 THEN list_transform(range((len(l{k}) + 2) // 3), "
               f"lambda j: sha256(array_to_string(l{k}[3 * j + 1:3 * j + 3], ''))) ELSE l{k} END AS l{k + 1} FROM {out})")
    return out


def _fold_sql(name: str) -> str:
    """Rows with cur, proof and i climb the levels l0 .. l15."""
    out = name
    for k in range(TREE_LEVELS):
        left, right = f"array_to_string(l{k}[i - i % 3 + 1:i], '')", f"array_to_string(l{k}[i + 2:i - i % 3 + 3], '')"
        out = (f"(SELECT * REPLACE (i // 3 AS i, CASE WHEN len(l{k}) > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur, "
               f"CASE WHEN len(l{k}) > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM {out})")
    return out


def _op13_sql() -> str:
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    changed = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    return rf"""
WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('(' + changed + ')')} AS changed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
g AS (SELECT source, list(leaf ORDER BY i) AS l0 FROM r GROUP BY source),
t AS (SELECT *, l{TREE_LEVELS}[1] AS subroot FROM {_levels_sql('g')}),
s AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gi FROM t),
u AS (SELECT *, l{TREE_LEVELS}[1] AS root FROM {_levels_sql('(SELECT list(subroot ORDER BY gi) AS l0 FROM s)')}),
f AS (SELECT doc_id, source, leaf, cur, proof FROM {_fold_sql("(SELECT doc_id, r.source, leaf, i, changed AS cur, '' AS proof, t.* EXCLUDE (source) "
                                                              "FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)")}),
k AS (SELECT doc_id, leaf, subroot, root, cur, proof FROM {_fold_sql("(SELECT doc_id, leaf, subroot, gi AS i, cur, proof, u.* FROM f "
                                                                     "JOIN s ON f.source IS NOT DISTINCT FROM s.source, u)")})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM k
"""


@query("op13_merkle_manifest", _op13_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.merkle import manifest
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], replaced={"text": changed})
