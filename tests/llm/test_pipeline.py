"""The corpus pipeline: stage order, columns, decisions, and the whole run against its parts."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
import pytest

from roadlens.llm.queries import QUERIES, table
from tests.conftest import SF0001

from .conftest import frame
from .test_decontam import brute, fold
from .test_dedup import brute_cut, exact_groups


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs = [], table(spark, SF0001, "documents")
    place = tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF0001).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append(docs)
    return out


def test_stages_and_columns(spark, staged):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    documents = table(spark, SF0001, "documents")
    for df in staged[:-1]:
        assert df.columns == documents.columns and df.schema["n_chars"].dataType == documents.schema["n_chars"].dataType


def test_decisions(spark, staged):
    documents = table(spark, SF0001, "documents")
    language, near, cut, clean, packed = staged
    judged = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF0001).collect()}
    assert {r.doc_id for r in language.collect()} == {i for i, r in judged.items() if r.lang_pred != "und"}
    groups = exact_groups(rows_of(language))
    assert {r.doc_id for r in near.collect()} == {i for i, (_, root) in groups.items() if i == root}
    removed = brute_cut(rows_of(near))
    left = {r.doc_id: r for r in cut.collect()}
    for i, t, _ in rows_of(near):
        if removed[i][1] == 0:
            assert left[i].text == t and left[i].n_chars == len(t)
        elif i in left:
            assert len(t.encode()) - len(left[i].text.encode()) >= removed[i][1]
    found = brute(rows_of(cut), [(r.item_id, r.text) for r in table(spark, SF0001, "benchmark").collect()])
    assert {str(r.doc_id) for r in clean.collect()} == {i for i, v in found.items() if not v[4]}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}
    assert documents.count() > language.count() * 0.9


def test_run_returns_the_last_stage(spark, staged):
    got = pipeline.run(spark, SF0001)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in staged[-1].collect())


def test_empty_and_odd_tables(spark, edge, tmp_path):
    sf = str(tmp_path / "sf")
    table(spark, SF0001, "benchmark").write.parquet(f"{sf}/benchmark.parquet")
    docs = edge.select(*edge.columns)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edge.columns
        assert stage(spark, frame(spark, []), sf).count() == 0
    assert {r.doc_id for r in docs.collect()} >= {6, 9, 11, 16} and 7 not in {r.doc_id for r in docs.collect()}


def test_words_of_the_stage_are_the_contracts():
    assert fold("A-b C9é") == re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "a-b c9é")
