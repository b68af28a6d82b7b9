"""Quality rules with risk-controlled cutoffs (operator 8); DataFrame functions only.

Counts of words, symbols, repeated lines and repeated 3-word windows come from array
functions over each whole text, without a shuffle.  Documents under the fixed base rule
fail; for the others each metric has a cutoff per stratum (language), chosen on labelled
rows so that rejecting at or above it is proven safe:

* a metric is a share between 0 and 1, cut into ``GRID`` equal bins (fixed in advance);
* for a cutoff, k of the n good labelled rows of the stratum are rejected falsely; the exact
  binomial tail P(Bin(n, risk / metrics) <= k) must be at most level / (metrics x strata).
  Cutoffs are tested from the most lenient down, so the grid costs nothing more, Bonferroni
  covers metrics and strata, and the risk of a stratum is at most the sum over its metrics;
* of the proven cutoffs the one with the best gain is taken: share of bad rows caught minus
  COST x share of good rows lost.  No gain, or too few labelled rows to prove one: no cutoff.

Edge cases: null or empty text has no words (base rule fails it); a null language is a
stratum of its own; rows without label are judged by the cutoffs but never counted; repeated
labels count once each; a stratum without labels has no cutoffs; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import cut

GRID = 100
COST = 100.0
METRICS = ["symbols", "dup_lines", "repeats", "capitals", "marks"]
SPACE = " \t\n\x0b\x0c\r"
HIGH, LOW = -(1 << 32), (1 << 32) - 1      # upper and lower half of a long


def _chars_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def base_counts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, the columns ``more``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and metric inputs.

    Each step is a projection of its own, so that an array is built once for each row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), *more, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.select("id", *more, F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"),
                        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"),
                        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
                        _chars_of(text, "#*$%&|<>").cast("long").alias("n_symbols"),
                        _chars_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
                        _chars_of(text, "!?").alias("n_marks"))
    kept = ["id", *more, "word_chars", "n_symbols", "n_capitals", "n_marks", "n_words", "n_lines", "n_dup_lines",
            "w"]
    hashed = (split.withColumn("n_words", F.size("w").cast("long")).withColumn("n_lines", F.size("lines"))
              .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
              .select(*kept, F.expr("""if(size(w) < 3, array(),
                  transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))""").alias("h")))
    # windows whose upper hash half is not alone, found on a sorted array of longs ...
    ranked = hashed.select(*kept, F.expr(f"""if(size(array_distinct(h)) < size(h),
        sort_array(transform(h, (x, i) -> (x & {HIGH}L) | cast(i as bigint))), cast(array() as array<bigint>))""")
                           .alias("s"))
    near = ranked.select(*kept, F.expr(f"""transform(filter(s, (x, i) ->
        (i > 0 and (s[i - 1] & {HIGH}L) = (x & {HIGH}L)) or (i < size(s) - 1 and (s[i + 1] & {HIGH}L) = (x & {HIGH}L))),
        x -> cast(x & {LOW}L as int))""").alias("p"))
    # ... and then compared in full
    grams = near.select(*kept, F.expr("""sort_array(transform(p, i ->
        struct(concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) as g, i as i)))""").alias("q"))
    found = grams.select(*kept, F.expr("""sort_array(transform(filter(q, (x, i) ->
        (i > 0 and q[i - 1].g = x.g) or (i < size(q) - 1 and q[i + 1].g = x.g)), x -> x.i))""").alias("d"))
    repeat = F.expr("""if(size(d) = 0, 0L, 3L + aggregate(zip_with(slice(d, 1, greatest(size(d) - 1, 0)),
        slice(d, 2, greatest(size(d) - 1, 0)), (a, b) -> least(3, b - a)), 0L, (t, x) -> t + x))""")
    return found.select(*kept[:-1], repeat.alias("n_repeat_words"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds one bin number (0 to GRID) for each metric."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.least(F.lit(GRID), F.floor(F.col(part) * GRID / F.col(whole)))).otherwise(0).cast("int")
    return counts.withColumns({
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars")})


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 1: Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) \
        + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
    down = F.log(x)
    for k in range(1, 8):
        down = down + F.log(x + float(k))
    return series - down


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), exact to double precision where k < n p; 1 where k >= n p."""
    k, n = k.cast("double"), n.cast("double")
    log_top = (log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p))
    steps = F.least(k, F.floor(20 * F.sqrt(n * p) + 60)).cast("int")   # what follows is below double precision
    series = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, i: F.struct((a.s + a.t).alias("s"), (a.t * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t")),
        lambda a: a.s)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * series)


def cutoffs(labelled: DataFrame, risk: float, level: float) -> DataFrame:
    """stratum, metric, cutoff from rows (stratum, good, one bin column for each metric)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in METRICS])).alias("m")
    binned = (labelled.select("stratum", "good", pairs)
              .groupBy("stratum", "m.metric", "m.bin")
              .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")))
    whole = Window.partitionBy("stratum", "metric")       # at most GRID + 1 rows each
    down = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    strata = labelled.select("stratum").distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).first()["n"]
    tested = (binned.select("stratum", "metric", "bin", F.sum("good").over(down).alias("k"),
                            F.sum("bad").over(down).alias("caught"), F.sum("good").over(whole).alias("n"),
                            F.sum("bad").over(whole).alias("n_bad")).where("bin > 0")
              .withColumn("gain", F.coalesce(F.try_divide("caught", "n_bad"), F.lit(0.0)) - COST * F.col("k") / F.col("n"))
              .withColumn("tail", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), F.lit(risk / len(METRICS))))))
    proven = tested.where((F.col("tail") <= level / (len(METRICS) * strata)) & (F.col("gain") > 0))
    return proven.groupBy("stratum", "metric").agg(F.max_by("bin", F.struct("gain", "bin")).alias("cutoff"))


MAX_STRATA = 100_000     # strata whose cutoffs are broadcast; more are joined by shuffle


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", good_col: str = "quality", label_id: str = "doc_id", risk: float = 0.03,
          level: float = 0.05, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """id, n_words, the counts, base_failed, kept and the metrics that rejected (``rejected_by``)."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), stratum)
    counts = cut(with_metrics(base_counts(rows, "own_id", "own_text", "stratum"))
                 .withColumn("base_failed", (F.col("n_words") < min_words)
                             | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))))
    own = labels.select(F.col(label_id).alias("id"), (F.col(good_col) == 1).alias("good")).where("good is not null")
    chosen = cut(cutoffs(counts.where(~F.col("base_failed")).join(own, "id").select("stratum", "good", *METRICS),
                         risk, level)
                 .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("cutoffs")))
    chosen = F.broadcast(chosen) if chosen.count() <= MAX_STRATA else chosen
    over = [F.when(F.col(m) >= F.col("cutoffs")[m], F.lit(m)) for m in METRICS]
    return (counts.join(chosen, "stratum", "left").withColumn("rejected_by", F.array_compact(F.array(*over)))
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by"))
