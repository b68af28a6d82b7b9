"""Operator 6 against a brute-force search for windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from roadlens.llm.decontam import decontaminate, n_words, without_hits

from .conftest import edge_rows, frame

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs: list[tuple], items: list[tuple]) -> dict:
    windows: dict = {}
    for item, text in items:
        w = fold(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = {}
    for i, text, _ in docs:
        w, hit, found = fold(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[str(i)] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs, items):
    table = spark.createDataFrame([(i, t, 1, "g", 2) for i, t in items], "item_id long, text string, id int, gram string, size int")
    rows = decontaminate(docs if not isinstance(docs, list) else frame(spark, docs), table).collect()
    return {str(r.doc_id): (r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
            for r in rows}, len(rows)


def cases(seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    say = lambda n, v=30: [f"v{r.randrange(v)}" for _ in range(n)]
    items = [(k, " ".join(say(r.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 25])))) for k in range(25)]
    items += [(100, items[7][1]), (101, None), (102, ""), (103, "!!!"), (104, "Ünï Cödé " * 6), (105, "same " * 12)]
    docs = []
    for k in range(60):
        text = say(r.randrange(0, 120))
        if k % 2:
            w = (r.choice(items)[1] or "").split()
            a, b = sorted((r.randrange(len(w) + 1), r.randrange(len(w) + 1)))
            text[5:5] = w if k % 4 == 1 else w[a:b]
        docs.append((k, r.choice([" ", ", ", "\n", "-"]).join(text).upper() if k % 3 else " ".join(text), None))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = cases(seed)
    got, _ = check(spark, docs, items)
    assert got == brute(docs, items)


def test_edge_rows(spark, edge):
    items = [(1, edge_rows()[5][1][:300]), (2, "one two three four"), (3, "ÜNïcödé tëxt"), (4, "same words same words same words same words same words same"), (5, None)]
    got, n = check(spark, edge, items)
    assert got == brute(edge_rows(), items) and n == len(edge_rows())
    none = brute(edge_rows(), [])
    assert check(spark, edge, [])[0] == none
    assert check(spark, [], items) == ({}, 0)


def test_passage_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(k, f"d{k} {passage} e{k}" if k % 3 == 0 else f"d{k} other words {k}", None) for k in range(900)]
    items = [(k, passage) for k in range(30)]
    got, _ = check(spark, docs, items)
    assert got == brute(docs, items)


def test_word_count(spark):
    texts = ["", "a", "A b-c_d 1é2", "日本 語", "\x00x\x7fy", "`z{", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(t, len(fold(t))) for t in texts]


def test_null_and_repeated_ids(spark):
    """Each row is judged by its own text, whatever its id."""
    passage = " ".join(f"p{k}" for k in range(14))
    docs = [(None, f"a {passage} b", "en"), (None, "clean text of another row", "en"), (None, None, None), (2, f"a {passage} b", "en"),
            (2, "clean as well", "en"), (3, f"c {passage}", "en"), (3, f"c {passage}", "en")]
    table = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = sorted(((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in decontaminate(frame(spark, docs), table).collect()))
    assert got == sorted([("None", 16, 14, True), ("None", 5, 0, False), ("None", 0, 0, False), ("2", 16, 14, True), ("2", 3, 0, False),
                          ("3", 15, 14, True), ("3", 15, 14, True)])
    left = without_hits(frame(spark, docs), table)
    assert left.columns == frame(spark, docs).columns
    assert sorted(str(r.text) for r in left.collect()) == ["None", "clean as well", "clean text of another row"]
    assert without_hits(frame(spark, []), table).count() == 0
