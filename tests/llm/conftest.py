from __future__ import annotations

import random

import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id long, row int, size string, region string, "
        "blob string, score double, kept string, n int, spans int, stratum int, held int, w int, a int, b int")
FILLER = (None, 7, "x", "r", "b", 0.5, "k", 3, 1, 2, 3, 4, 5, 6)


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def frame(spark, rows: list[tuple]):
    """A documents table (doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *FILLER) for i, t, lang in rows], DOCS)


def edge_rows() -> list[tuple]:
    """Nulls, empties, repeats, ties, very long texts, odd characters."""
    long_text = words(1, 120_000)
    base = words(2, 300)
    near = base.split()
    near[150] = "changed"
    return [
        (1, None, "en"), (2, "", "en"), (3, "   \t\n ", None), (4, "a", "en"), (5, "1234 !!! ###", "en"), (6, base, "en"),
        (7, base, "en"), (8, " ".join(near), None), (9, long_text, "de"), (10, long_text + " tail", "de"),
        (11, "Ünïcödé tëxt – with “quotes”, 日本語 and\u00a0spaces " * 9, "fr"), (12, "x" * 200_000, "fr"),
        (13, "same words " * 400, "es"), (14, "same words " * 400, "es"), (14, "same words " * 400, "es"),
        (15, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "en"),
        (16, "one two three four", None), (17, "one two three four", None), (18, "\x00\x01 control \x1c\x0b chars", "en"),
        (None, words(5, 80), "en"), (-3, words(6, 60), "en"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, edge_rows()).repartition(3).cache()
