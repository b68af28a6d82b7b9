"""Operator 1: held-out accuracy, mixtures and edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from roadlens.llm import langid
from roadlens.llm.queries import QUERIES, table
from tests.conftest import SF001

from .conftest import edge_rows, frame


@pytest.fixture(scope="module")
def found(spark):
    docs = table(spark, SF001, "documents").toPandas().set_index("doc_id")
    return QUERIES["op1_language_id"](spark, SF001).toPandas().set_index("doc_id").join(docs[["lang", "text"]])


def test_held_out_accuracy(found):
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.index]


def test_mixture_finds_both_languages(spark):
    docs = table(spark, SF001, "documents")
    languages, model = langid.fit(langid.labelled_rows(docs), "text", "lang", "doc_id", 4000)
    pure = {r.lang: r.text for r in docs.where("length(text) between 1500 and 4000").collect()}
    mixed = (pure["en"][:1200] + " " + pure["es"][:600]).encode()
    data = np.frombuffer(mixed, np.uint8)
    best, score = langid.predict(*langid.gram_counts(data, np.array([0, len(data)])), model, 1)
    assert languages[best[0]] == "en" and 0.45 < score[0] < 0.85


def test_grams_do_not_cross_rows():
    one = langid.gram_counts(np.frombuffer(b"abcdef", np.uint8), np.array([0, 3, 6]))
    two = [langid.gram_counts(np.frombuffer(t, np.uint8), np.array([0, 3])) for t in (b"abc", b"def")]
    assert one[0].tolist() == [0, 1]
    assert one[1].tolist() == [two[0][1][0], two[1][1][0]]


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    data = np.frombuffer(("some words with Größe and 12 numbers, " * 90).encode(), np.uint8)
    whole = langid.gram_counts(data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "LONG", 100)
    assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(data, np.array([0, len(data)]))))


def test_edge_rows(spark, edge):
    rows = langid.identify(edge, langid.labelled_rows(edge)).collect()
    assert len(rows) == len(edge_rows())
    texts = {str(i): t for i, t, _ in edge_rows()}
    for r in rows:
        empty = not any(c.isalpha() for c in texts[str(r.doc_id)] or "")
        assert (r.lang_pred == "und") == empty and (not empty or r.score == 0.0)
    unlabelled = frame(spark, [(1, "some text", None)])
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled, langid.labelled_rows(unlabelled)).collect()] == [("und", 0.0)]
    assert langid.identify(frame(spark, []), langid.labelled_rows(edge)).count() == 0


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.identify(frame(spark, [(1, "a b", "x"), (2, "c d", "y")]), frame(spark, [(1, "a b", "x"), (2, "c d", "y")]))


def test_letters_without_grams_get_the_commonest_language(spark):
    rows = [(k, f"the words of an english text number {k} go on", "en") for k in range(2)]
    rows += [(10 + k, f"las palabras de un texto en castellano {k} siguen", "es") for k in range(6)]
    labelled = frame(spark, rows)
    odd = frame(spark, [(1, "a", None), (2, "é", None), (3, "", None), (4, "12 !", None), (5, "the words go on", None), (None, "b", None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, labelled).collect()}
    assert got[1] == ("es", 0.75) and got[None] == ("es", 0.75) and got[2][0] in ("es", "en")
    assert got[3] == got[4] == ("und", 0.0) and got[5][0] == "en"
    none = langid.identify(odd, frame(spark, [])).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)


def test_the_chunk_does_not_change_the_result(spark, monkeypatch):
    docs = table(spark, SF001, "documents").limit(60)
    labelled = langid.labelled_rows(table(spark, SF001, "documents"))
    want = sorted(langid.identify(docs, labelled).collect())
    monkeypatch.setattr(langid, "CHUNK", 1 << 14)
    got = sorted(langid.identify(docs, labelled).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(got, want))
