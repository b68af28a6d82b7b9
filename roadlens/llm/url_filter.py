"""URL filter: host and path rules, then a character language-model ratio (operator 4).

DataFrame functions only.  Rules decide first (longest rule that fits the host or one of its
parents and starts the path).  The URLs they decide are the training data of two smoothed
variable-order Markov models, accepted and rejected: the probability of a character after
its last three is interpolated with the one after the last two, and so on down to uniform,
so that an unseen context falls back by itself.  A URL no rule fits is judged by the mean,
over its characters, of the log ratio of both models; the cutoff is calibrated on URLs held
out of training (three in sixteen, by a hash of the URL).

Characters are folded to an alphabet of 34 symbols, so there are at most 34^4 (1.3 million)
4-grams however many URLs there are: the model table may be broadcast, and URLs are scored
without shuffling their characters.

Edge cases: a null URL or one without ``://`` has an empty host and path and is judged as an
empty string; with no rule-decided URL of one of the kinds the ratio is 0 and the verdict is
allow; equally good cutoffs: the one nearest to 0; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import cut

SYMBOLS = 34
PRIOR = 2.0              # weight of the shorter context
HELD_BELOW = "3"         # held out: first digit of the URL's MD5 is 0, 1 or 2 (three in sixteen)
STEP = 100               # cutoffs are multiples of 1 / STEP
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]          # (allow or block, host, path)


def address(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def four_grams(text: Column) -> Column:
    """The folded characters of a URL as an array, padded by three starts and one end."""
    x = F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]", "0")
    x = F.regexp_replace(F.regexp_replace(x, "[?=&#%:~+]", "?"), "_", "-")
    x = F.regexp_replace(x, "[^a-z0./?-]", "*")
    return F.split(F.concat(F.lit("^^^"), x, F.lit("$")), "")


def exploded(urls: DataFrame, *kept: str) -> DataFrame:
    """One row per character with the 4-gram that ends there."""
    chars = urls.select(*kept, four_grams(F.col("text")).alias("c"))
    return chars.select(*kept, F.expr(
        "explode(transform(sequence(0, size(c) - 4), i -> concat(c[i], c[i + 1], c[i + 2], c[i + 3])))").alias("gram"))


def log_ratios(training: DataFrame) -> DataFrame:
    """gram, delta for every 4-gram of all URLs, from rows (gram, allowed, blocked as 0 or 1)."""
    grams = cut(training.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    total = grams.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("allowed"),
                      F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    out = grams
    for kind in ("allowed", "blocked"):
        def over(start: int, size: int, kind=kind) -> Column:
            return F.sum(kind).over(Window.partitionBy(F.substring("gram", start, size)))
        p = (over(4, 1) + PRIOR / SYMBOLS) / (total[kind] + PRIOR)
        for start in (3, 2):
            p = (over(start, 5 - start) + PRIOR * p) / (over(start, 4 - start) + PRIOR)
        out = out.withColumn(f"p_{kind}", (F.col(kind) + PRIOR * p) / (over(1, 3) + PRIOR))
    known = total["allowed"] > 0 and total["blocked"] > 0
    delta = F.log("p_allowed") - F.log("p_blocked") if known else F.lit(0.0)
    return out.select("gram", delta.alias("delta"))


def calibrated(scores: DataFrame) -> float:
    """The cutoff with the best sum of accepted share kept and rejected share blocked; of equally good
    ones (all between two neighbouring scores) the one nearest to 0, where both models agree."""
    bins = (scores.groupBy(F.floor(F.col("score") * STEP).alias("bin"))
            .agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")))
    whole = Window.orderBy("bin")           # bins of a bounded score, not rows
    low = F.coalesce(F.lag("bin").over(whole) + 1, F.lit(0))
    place = F.when(F.col("bin") < 0, F.col("bin")).when(low > 0, low).otherwise(0)
    best = (bins.withColumn("cut", place)
            .withColumn("below_a", F.sum("a").over(whole) - F.col("a"))
            .withColumn("below_b", F.sum("b").over(whole) - F.col("b"))
            .withColumn("gain", F.try_divide("below_b", F.sum("b").over(Window.partitionBy()))
                        - F.try_divide("below_a", F.sum("a").over(Window.partitionBy())))
            .agg(F.max_by("cut", F.struct(F.round("gain", 9), -F.abs("cut"), "cut")).alias("cut"),
                 F.max("gain").alias("gain")).first())
    return 0.0 if best is None or best["gain"] is None else best["cut"] / STEP


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (mean log ratio; null where a rule decides)."""
    host, path = address(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = (named.withColumn("rule", rule).withColumn("by_rule", verdict)
            .withColumn("text", F.concat("host", "path"))
            .withColumn("held", F.substring(F.md5(F.col("text").cast("binary")), 1, 1) < HELD_BELOW))
    is_a = lambda kind, held: ((F.col("by_rule") == kind) & (F.col("held") == held)).cast("int")
    flags = [F.coalesce(is_a("allow", False), F.lit(0)).alias("allowed"),
             F.coalesce(is_a("block", False), F.lit(0)).alias("blocked")]
    model = F.broadcast(log_ratios(exploded(urls.select("text", *flags), "allowed", "blocked")))
    # equal texts have equal scores: each is scored once
    texts = (urls.where(F.col("by_rule").isNull() | F.col("held"))
             .groupBy("text").agg(F.sum(F.coalesce(is_a("allow", True), F.lit(0))).alias("allowed"),
                                  F.sum(F.coalesce(is_a("block", True), F.lit(0))).alias("blocked")))
    scores = cut(exploded(texts, "text", "allowed", "blocked").join(model, "gram")
                 .groupBy("text", "allowed", "blocked").agg(F.round(F.avg("delta"), 9).alias("score")))
    cutoff = calibrated(scores.where("allowed + blocked > 0"))
    judged = urls.join(scores.select("text", "score"), "text", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("by_rule", F.when(F.col("score") < cutoff, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"))
