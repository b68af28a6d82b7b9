"""Language ID by mixture inference (operator 1).

Each language is a smoothed distribution over hashed byte 3-grams (lower-case letters; a
gram centred on white space, a digit or punctuation is not counted).  A document's grams
are a mixture: expectation-maximisation estimates the language proportions, and the set of
languages grows by one, most likely first, only while the log-likelihood gain exceeds a
Bayesian-information penalty.  The language with the largest proportion is predicted, the
proportion is the score.  Inference runs over whole texts, many documents at a time.

The language models are fitted on a bounded, hashed sample of labelled rows:
``rows_per_language`` documents of each language at most (on average).  The fitted table
has ``BUCKETS`` x languages numbers; more than ``MAX_LANGUAGES`` labels is an error.  The bytes
inferred at a time shrink as languages grow.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is everything
if no row is labelled; a text with a letter but without a 3-gram gets the language of most
labelled rows, with its share of them as the score; repeated rows are judged alike; ties go to the language that sorts
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import row_chunks, small_batches, utf8

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
CHUNK = 1 << 20
LONG = 4 << 20           # bytes of one text that are counted at a time
STEPS = 12
SMOOTHING = 0.5
PENALTY = 6.0            # times log(n) / 2 for each language after the first: grams overlap
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3-gram from each byte; BUCKETS where its middle is no letter."""
    x = _FOLD[data]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    code[x[1:-1] == 32] = BUCKETS
    return code


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct grams of each row; no gram crosses rows."""
    n = len(offsets) - 1
    if n == 1 and len(data) > LONG:              # piece by piece, pieces overlap by two bytes
        total = np.zeros(BUCKETS, np.int64)
        for lo in range(0, len(data) - 2, LONG):
            code = grams(data[lo:lo + LONG + 2])
            total += np.bincount(code[code < BUCKETS], minlength=BUCKETS)
        bucket = np.flatnonzero(total)
        return np.zeros(len(bucket), np.int64), bucket, total[bucket]
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = grams(data)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))[:-2]
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    inside &= code < BUCKETS
    key = (row[inside] << 16) | code[inside]
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 16, key[first] & (BUCKETS - 1), np.diff(np.r_[first, len(key)])


def mixture(row: np.ndarray, p: np.ndarray, count: np.ndarray, start: np.ndarray, weights: np.ndarray,
            steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for all rows at once: proportions and log-likelihoods."""
    size = np.add.reduceat(count, start)[:, None]
    for _ in range(steps):
        share = p * weights[row]
        share *= (count / share.sum(1))[:, None]
        weights = np.add.reduceat(share, start) / size
    return weights, np.add.reduceat(count * np.log((p * weights[row]).sum(1)), start)


def predict(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, model: np.ndarray, rows: int,
            ) -> tuple[np.ndarray, np.ndarray]:
    """(language index, proportion) for each of ``rows`` rows; language 0, 0.0 where there is no gram."""
    best, score = np.zeros(rows, np.int64), np.zeros(rows)
    if not len(row):
        return best, score
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ids, local = row[start], np.cumsum(np.r_[False, row[1:] != row[:-1]])
    p, count, k = model[bucket], count.astype(float), model.shape[1]
    weights, _ = mixture(local, p, count, start, np.full((len(ids), k), 1.0 / k), STEPS)
    order = np.argsort(-weights, axis=1, kind="stable")
    single = np.add.reduceat(count[:, None] * np.log(p), start)
    chosen = np.zeros((len(ids), k))
    top = single.argmax(1)
    chosen[np.arange(len(ids)), top] = 1.0
    likelihood, penalty = single.max(1), 0.5 * PENALTY * np.log(np.add.reduceat(count, start) + 1.0)
    growing = np.flatnonzero(weights[np.arange(len(ids)), order[:, 0]] < 1.0)
    for size in range(2, k + 1):
        growing = growing[weights[growing, order[growing, size - 1]] > 0]
        if not len(growing):
            break
        wanted = np.full(len(ids), -1)
        wanted[growing] = np.arange(len(growing))
        sub = wanted[local] >= 0
        sub_row = wanted[local[sub]]
        allowed = np.zeros((len(growing), k))
        np.put_along_axis(allowed, order[growing, :size], 1.0 / size, axis=1)
        sub_start = np.flatnonzero(np.r_[True, sub_row[1:] != sub_row[:-1]])
        w, ll = mixture(sub_row, p[sub], count[sub], sub_start, allowed, STEPS)
        better = ll - likelihood[growing] > penalty[growing]
        kept = growing[better]
        chosen[kept], likelihood[kept], growing = w[better], ll[better], kept
    best[ids] = chosen.argmax(1)
    score[ids] = np.clip(chosen.max(1), 0.0, 1.0)
    return best, score


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, rows_per_language: int,
        ) -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages probabilities) from a bounded sample of labelled rows."""
    return fit_with_prior(labelled, text_col, lang_col, id_col, rows_per_language)[:2]


def fit_with_prior(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, rows_per_language: int,
                   ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``fit``, and each language's share of all labelled rows."""
    small_batches(labelled.sparkSession)
    seen = {r.lang: r.n for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
            .limit(MAX_LANGUAGES + 1).collect()}
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    languages = sorted(seen)
    if not languages:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0)
    prior = np.array([seen[k] for k in languages], float)
    spark = labelled.sparkSession
    share = spark.createDataFrame([(k, min(1_000_000, rows_per_language * 1_000_000 // n + 1), i)
                                   for i, (k, n) in enumerate(sorted(seen.items()))],
                                  "lang string, share long, code int")      # one row per language
    sample = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                              F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)).alias("at"))
              .join(F.broadcast(share), "lang").where("at < share").select("code", "text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            code = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offsets, CHUNK):
                row, bucket, n = gram_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                np.add.at(total, (code[lo:hi][row], bucket), n)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)),
                                          pa.array(total[lang, bucket])], names=["code", "bucket", "n"])

    sums = sample.mapInArrow(counted, "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS, len(languages)))
    got = sums.toPandas()
    table[got["bucket"].to_numpy(), got["code"].to_numpy()] = got["n"].to_numpy()
    table += SMOOTHING
    return languages, table / table.sum(0), prior / prior.sum()


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", rows_per_language: int = 4_000) -> DataFrame:
    """id, lang_pred, score for each row of ``docs``; the models come from ``labelled`` (no null label)."""
    languages, *model = fit_with_prior(labelled, text_col, lang_col, id_col, rows_per_language)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), has_letter(text_col).alias("letter"))
    kind = docs.schema[id_col].dataType.simpleString()
    return (rows.mapInArrow(inference(docs, languages, *model), f"id {kind}, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


def annotate(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", rows_per_language: int = 4_000) -> DataFrame:
    """row (a struct of all columns of ``docs``), lang_pred, score: texts are not joined to their results."""
    languages, *model = fit_with_prior(labelled, text_col, lang_col, id_col, rows_per_language)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), has_letter(text_col).alias("letter"))
    out = T.StructType([whole.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return whole.mapInArrow(inference(docs, languages, *model), out)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))


def inference(docs: DataFrame, languages: list[str], model: np.ndarray, prior: np.ndarray):
    """Task function: (a column to pass on, text, has a letter) in; (the column, lang_pred, score) out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chunk = max(CHUNK >> 4, CHUNK * 8 // max(8, len(languages)))

    def inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            for lo, hi in row_chunks(offsets, chunk):
                part = gram_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                if languages:
                    best[lo:hi], score[lo:hi] = predict(*part, shared.value, hi - lo)
            if languages:
                bare = score == 0.0
                best[bare], score[bare] = prior.argmax(), prior.max()
            best = np.where(letters & bool(languages), best, len(languages))
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                                             names=[batch.schema.names[0], "lang_pred", "score"])

    return inferred


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows a model may learn from: labelled, and not held out."""
    return docs.where(F.col(lang_col).isNotNull() & F.coalesce(~is_held_out(id_col), F.lit(True)))
