"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; a stage's decision takes effect on what its predecessor kept:

1. language ID: rows without a language (``und``) go, texts of several languages stay; the
   models are fitted on the labelled rows of the stage's input;
2. near-dedup: of each group of near duplicates the smallest id stays;
3. suffix-array dedup: repeated passages are cut out of the texts, ``n_chars`` is set anew;
   rows of which nothing is left go;
4. decontamination: rows with a benchmark window go;
5. packing: the pieces of what is left, placed into sequences.

Null and empty texts have no language, so the first stage drops them.  Rows with a null id
pass the first two stages, and are left uncut by the third (their texts remove nothing).
Extra columns of ``documents`` pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.queries import table, word_bpe
from roadlens.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from roadlens.llm.langid import UNKNOWN, annotate, labelled_rows
    judged = annotate(docs, labelled_rows(docs))
    return judged.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from roadlens.llm.neardup import near_duplicates
    dropped = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from roadlens.llm.suffix_dedup import cut_repeats
    left = cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.where("length(trim(text)) > 0").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from roadlens.llm.decontam import without_hits
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from roadlens.llm.packing import pack
    return pack(docs, word_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination), ("packing", packing)]

#: Mixture inference, segment removal and the packing program are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared checkpoint folder."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
