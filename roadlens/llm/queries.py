"""Driver queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), word_bpe())


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), word_bpe())


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from roadlens.llm.langid import identify, is_held_out, labelled_rows
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, labelled_rows(docs))
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM bg),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, i, bg.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) x
      JOIN bg ON x.g = bg.g AND x.n = bg.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from roadlens.llm.decontam import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM
      (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT s.doc_id, stratum, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(t) - len(regexp_replace(t, '[!?]', '', 'g')) AS n_marks FROM s LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS (SELECT doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'marks']) AS metric,
      unnest([[n_symbols, word_chars], [n_dup_lines, n_lines], [n_repeat_words, n_words], [n_capitals, word_chars],
              [n_marks, word_chars]]) AS v FROM f),
b AS (SELECT doc_id, stratum, base_failed, metric,
      CASE WHEN v[2] > 0 THEN least(100, floor(v[1] * 100 / v[2])) ELSE 0 END AS bin FROM m),
lab AS (SELECT stratum, metric, bin, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad
        FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
k AS (SELECT stratum, metric, bin, sum(good) OVER d AS k, sum(bad) OVER d AS caught, sum(good) OVER e AS n, sum(bad) OVER e AS n_bad
      FROM lab WINDOW d AS (PARTITION BY stratum, metric ORDER BY bin DESC), e AS (PARTITION BY stratum, metric)),
q AS (SELECT *, coalesce(caught / nullif(n_bad, 0), 0) - 100 * k / n AS gain, 0.03 / 5 AS p,
      (SELECT count(DISTINCT stratum) FROM lab) AS strata FROM k WHERE bin > 0 AND n > 0),
z AS (SELECT stratum, metric, bin, gain FROM q WHERE gain > 0 AND k < n * p AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) <= 0.05 / (5 * strata)),
x AS (SELECT stratum, metric, max_by(bin, gain * 1e6 + bin / 1e6) AS cutoff FROM z GROUP BY ALL),
j AS (SELECT b.doc_id, bool_or(bin >= cutoff) AS rejected FROM b JOIN x USING (stratum, metric) GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM f LEFT JOIN j USING (doc_id)
"""


@query("op8_quality_rules", OP8_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.quality import judge
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


OP4_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS x FROM pages),
a AS (SELECT page_id, coalesce(translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
      ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(action, len(h || p)) AS by_rule
      FROM a JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
t AS (SELECT a.page_id, host, path, rule, by_rule, host || path AS text, left(md5(host || path), 1) < '3' AS held,
      '^^^' || regexp_replace(replace(regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[?=&#%:~+]', '?', 'g'), '_', '-'), '[^a-z0./?-]', '*', 'g') || '$' AS s
      FROM a LEFT JOIN f USING (page_id)),
e AS (SELECT by_rule, held, substr(s, i, 4) AS g FROM (SELECT *, unnest(range(1, len(s) - 2)) AS i FROM t)),
d AS (SELECT g, count(*) FILTER (by_rule = 'allow' AND NOT held) AS a, count(*) FILTER (by_rule = 'block' AND NOT held) AS b FROM e GROUP BY g),
n AS (SELECT sum(a) AS na, sum(b) AS nb FROM d),
p1 AS (SELECT d.*, (sum(a) OVER (PARTITION BY substr(g, 4, 1)) + 2.0::DOUBLE / 34) / (na + 2.0::DOUBLE) AS pa,
       (sum(b) OVER (PARTITION BY substr(g, 4, 1)) + 2.0::DOUBLE / 34) / (nb + 2.0::DOUBLE) AS pb, na > 0 AND nb > 0 AS known FROM d, n),
p2 AS (SELECT g, a, b, known, (sum(a) OVER (PARTITION BY substr(g, 3, 2)) + 2.0::DOUBLE * pa) / (sum(a) OVER (PARTITION BY substr(g, 3, 1)) + 2.0::DOUBLE) AS pa,
       (sum(b) OVER (PARTITION BY substr(g, 3, 2)) + 2.0::DOUBLE * pb) / (sum(b) OVER (PARTITION BY substr(g, 3, 1)) + 2.0::DOUBLE) AS pb FROM p1),
p3 AS (SELECT g, a, b, known, (sum(a) OVER (PARTITION BY substr(g, 2, 3)) + 2.0::DOUBLE * pa) / (sum(a) OVER (PARTITION BY substr(g, 2, 2)) + 2.0::DOUBLE) AS pa,
       (sum(b) OVER (PARTITION BY substr(g, 2, 3)) + 2.0::DOUBLE * pb) / (sum(b) OVER (PARTITION BY substr(g, 2, 2)) + 2.0::DOUBLE) AS pb FROM p2),
m AS (SELECT g, CASE WHEN known THEN ln((a + 2.0::DOUBLE * pa) / (sum(a) OVER (PARTITION BY substr(g, 1, 3)) + 2.0::DOUBLE))
      - ln((b + 2.0::DOUBLE * pb) / (sum(b) OVER (PARTITION BY substr(g, 1, 3)) + 2.0::DOUBLE)) ELSE 0 END AS delta FROM p3),
x AS (SELECT text, s, count(*) FILTER (by_rule = 'allow' AND held) AS a, count(*) FILTER (by_rule = 'block' AND held) AS b
      FROM t WHERE by_rule IS NULL OR held GROUP BY text, s),
c AS (SELECT text, a, b, round(avg(delta), 9) AS score FROM (SELECT *, unnest(range(1, len(s) - 2)) AS i FROM x) y
      JOIN m ON m.g = substr(s, i, 4) GROUP BY text, a, b),
h AS (SELECT floor(score * 100) AS bin, sum(a) AS a, sum(b) AS b FROM c WHERE a + b > 0 GROUP BY 1),
k AS (SELECT CASE WHEN bin < 0 THEN bin WHEN lag(bin) OVER w + 1 > 0 THEN lag(bin) OVER w + 1 ELSE 0 END AS cut,
      round((sum(b) OVER w - b) / nullif(sum(b) OVER (), 0) - (sum(a) OVER w - a) / nullif(sum(a) OVER (), 0), 9) AS gain
      FROM h WINDOW w AS (ORDER BY bin)),
z AS (SELECT coalesce((SELECT cut FROM k WHERE gain IS NOT NULL ORDER BY gain DESC, abs(cut), cut DESC LIMIT 1), 0) / 100 AS cutoff)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score < cutoff THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN c USING (text), z
"""


@query("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.url_filter import judge
    return judge(table(spark, sf_dir, "pages"), OP4_RULES).drop("score")


# Of its own: sentences as one reads them, their identifiers, and what they stand for.
OP7_SENTENCES = [
    ("Licensed under the Apache License, Version 2.0.", "apache.name", "Apache-2.0"),
    ("Released under the MIT License.", "short.MIT", "MIT"), ("Licensed under the MIT license.", "short.MIT", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl.work3", "GPL-3.0"),
    ("Licensed under the GNU General Public License, version 3.", "short.GPL-3.0", "GPL-3.0"),
    ("Licensed under CC BY 4.0.", "short.CC-BY-4.0", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "short.CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0.", "short.CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("All rights reserved.", "rights", "All-rights-reserved"),
    ("This is free and unencumbered software released into the public domain.", "unlicense", "Unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl.20", "MPL-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost.short", "BSL-1.0"),
    ("SPDX-License-Identifier: MIT", "short.MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "short.Apache-2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0", "short.GPL-3.0", "GPL-3.0"),
]


def _op7_sql() -> str:
    """Every sentence as a pattern over the whole normalised text: its words with line breaks (<) between
    them, from a break or sentence end (>) to the next; places order what is found."""
    values = ", ".join("('{}', '{}', '{}')".format(s.replace("'", "''"), i, c) for s, i, c in OP7_SENTENCES)
    return rf"""
WITH known(raw, code, licence) AS (VALUES {values}),
k AS (SELECT code, licence, '(^|[<>])( *)' || regexp_replace(trim(regexp_replace(regexp_replace(lower(raw), '\bv\. ([0-9])', 'v \1'), '[^a-z0-9]+', ' ', 'g')),
      ' ', '[ <]+', 'g') || '( *)([<>]|$)' AS p FROM known),
t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<>]', ' ', 'g'), '\bv\.(\s+[0-9])', 'v\1', 'g'),
      '[.!?]+(\s|$)', ' >> \1', 'g'), '\n[ \t]*\n', ' >> ', 'g'), '\n', ' << ', 'g'), '[^a-z0-9<>]+', ' ', 'g') AS x
      FROM documents WHERE regexp_matches(lower(text), 'licen|rights|unencumbered|source code form')),
f AS (SELECT doc_id, code, licence, length(string_agg(part, '') OVER (PARTITION BY doc_id, code, p ORDER BY i ROWS UNBOUNDED PRECEDING)) AS pos, n, i FROM
      (SELECT doc_id, code, licence, p, unnest(regexp_split_to_array(x, p)) AS part, generate_subscripts(regexp_split_to_array(x, p), 1) AS i,
              len(regexp_split_to_array(x, p)) AS n FROM t JOIN k ON regexp_matches(x, p))),
g AS (SELECT doc_id, string_agg(code, ' ' ORDER BY pos) AS sequence, count(*) AS n_sentences, list_sort(list_distinct(list(licence))) AS l FROM f WHERE i < n GROUP BY 1)
SELECT doc_id, coalesce(sequence, '') AS sequence, coalesce(n_sentences, 0) AS n_sentences, coalesce(array_to_string(l, ','), '') AS licences
FROM documents LEFT JOIN g USING (doc_id)
"""


@query("op7_license_scan", _op7_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from roadlens.llm.license import scan
    return scan(table(spark, sf_dir, "documents")).withColumn("licences", F.concat_ws(",", "licences"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("sha256", "kept_sha256")


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlens.llm.neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


from roadlens.llm import chat_queries  # noqa: E402, F401  (registers operators 11 to 13)
