"""Operators 4, 7 and 8 (DataFrame functions only) against DuckDB and by hand."""

from __future__ import annotations

import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from roadlens.llm import license, quality, url_filter
from roadlens.llm.queries import OP4_RULES, ORACLES, QUERIES
from tests.conftest import SF0001

from .conftest import edge_rows, frame

NATIVE = ["op4_url_filter", "op7_license_scan", "op8_quality_rules"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF0001).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda t: sorted(map(repr, t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_plan(spark, name):
    plan = QUERIES[name](spark, SF0001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Arrow", plan)


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://www.example.com", "x.net/es/", None,
            "http://b.net/es/1", "http://b.net/fr", "http://b.net/fr/", "s://net/es/?x", "http://notexample.com/en/", "://h?p/q", "a://b://c"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id int, url string, text int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, OP4_RULES).collect()}
    assert got[0][:3] == ("a.example.com", "/en/x", "example.com/en/") and got[0][3] == "block"
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][:3] == ("www.example.com", "", None)
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None)
    assert got[5][2:] == ("net/es/", "block") and got[6][2] is None and got[7][2] == "net/fr/"
    assert got[8] == ("net", "/es/", "net/es/", "block")
    assert got[9][2:] == ("com/", "allow")
    assert got[10][:2] == ("h", "") and got[11][:2] == ("b:", "//c")
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), OP4_RULES).count() == 0
    assert [r.verdict for r in url_filter.judge(pages, []).collect()] == ["allow"] * len(urls)


def test_url_model_learns_paths(spark):
    rows = [(f"http://a{k}.com/good/{k}", "x") for k in range(80)] + [(f"http://b{k}.net/bad/{k}", "x") for k in range(80)]
    rows += [("http://c.org/good/1", "y"), ("http://c.org/bad/1", "y"), ("http://c.org/bad/" + "9" * 5000, "y")]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [("allow", "com", "/"), ("block", "net", "/")]).collect()}
    assert [got[160], got[161]] == ["allow", "block"]


def test_binomial_tail(spark):
    cases = [(0, 100, 0.02), (1, 100, 0.02), (5, 400, 0.02), (30, 3000, 0.0125), (900, 100_000, 0.01), (0, 1, 0.5)]
    rows = spark.createDataFrame(cases, "k long, n long, p double").select(
        "*", quality.binomial_tail(F.col("k"), F.col("n"), F.lit(0.02)).alias("at_2"),
        quality.binomial_tail(F.col("k"), F.col("n"), F.lit(0.0125)).alias("at_1")).collect()
    for r in rows:
        for p, got in ((0.02, r.at_2), (0.0125, r.at_1)):
            want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p)
                                + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
            assert got == (1.0 if r.k >= r.n * p else pytest.approx(want, rel=1e-8))


def brute_counts(text: str) -> tuple:
    w = re.findall("[^\x20\x09-\x0D]+", text)
    grams: dict = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(len(re.findall("[#*$%&|<>]", x)) for x in w), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_on_edge_rows(spark, edge):
    labels = frame(spark, [(6, "", "")]).selectExpr("doc_id", "1 as quality", "0 as toxic")
    rows = quality.judge(edge, labels).collect()
    want = sorted((str(i), *brute_counts(t or "")) for i, t, _ in edge_rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)           # one labelled row proves nothing
    assert quality.judge(edge, labels.limit(0)).where("kept").count() == sum(r.kept for r in rows)
    assert quality.judge(frame(spark, []), labels).count() == 0


def test_cutoffs_hold_their_risk(spark):
    text = lambda k, bad: " ".join(f"w{k}x{j}" + ("###" if bad else "") for j in range(60))
    rows = [(k, text(k, k % 10 == 0), "en") for k in range(4000)] + [(9000 + k, text(k, True), "few") for k in range(5)]
    docs = frame(spark, rows)
    labels = docs.selectExpr("doc_id", "if(text like '%#%', 0, 1) as quality")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[k].kept == (k % 10 != 0) for k in range(4000))
    assert all(got[9000 + k].kept for k in range(5))        # too few labelled rows in this stratum


MIT = """Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD2 = """Copyright (c) 2001, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
NOTICES = [(MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (BSD2, ["All-rights-reserved", "BSD-2-Clause"]), (BSD3, ["All-rights-reserved", "BSD-3-Clause"]),
           (GPL, ["GPL-3.0-or-later"]), (LGPL, ["LGPL-2.1-or-later"]), (MPL, ["MPL-2.0"]), (ISC, ["ISC"])]


def shapes(notice: str) -> list[str]:
    """As published, wrapped at three widths, behind comment marks, on one line."""
    paragraphs = notice.split("\n\n")
    wrapped = ["\n\n".join("\n".join(textwrap.wrap(p, w)) for p in paragraphs) for w in (40, 72, 80)]
    marked = ["\n".join((mark + line).rstrip() for line in wrapped[1].split("\n")) for mark in ("# ", "// ", " * ", ";; ", "-- ")]
    block = "/*\n" + marked[2] + "\n */\nint main() { return 0; }"
    return [notice, *wrapped, *marked, block, wrapped[1].replace("\n", "\r\n"), "Some words before it.\n\n" + wrapped[2] + "\n\nand after it"]


def test_published_notices_are_found(spark):
    rows, want = [], {}
    for notice, licences in NOTICES:
        for text in shapes(notice):
            want[len(rows)] = licences
            rows.append((len(rows), text, "en"))
    for text, licence in (("Licensed under the MIT License.", "MIT"), ("SPDX-License-Identifier: GPL-3.0\ncode", "GPL-3.0"), ("# Released under the Apache License 2.0!", "Apache-2.0"),
                          ("A title\nLicensed under CC BY-SA 4.0.\nMore", "CC-BY-SA-4.0"),
                          ("This work is licensed under a Creative Commons Attribution\n4.0 International License.", "CC-BY-4.0")):
        want[len(rows)] = [licence]
        rows.append((len(rows), text, "en"))
    got = {r.doc_id: r.licences for r in license.scan(frame(spark, rows)).collect()}
    assert got == want


def test_no_known_sentence_is_skipped(spark):
    """Every known sentence is found, in upper case and with a line break between any two words."""
    table, _ = license.known()
    known = sorted(table)
    rows = [(i, s.upper() if i % 2 else s.replace(" ", "\n"), "en") for i, s in enumerate(known)]
    got = {r.doc_id: r.sequence for r in license.scan(frame(spark, rows)).collect()}
    assert [s for i, s in enumerate(known) if table[s] not in got[i].split(" ")] == []


def test_license_sequences(spark, edge):
    table, rules = license.known()
    assert len({name for name, _ in rules}) > 30
    assert [r[1].count(" ") for r in rules] == sorted((r[1].count(" ") for r in rules), reverse=True)     # longer rules first
    full = [(1, "Licensed under the Apache License, Version 2.0 (the \"License\").", "en"),
            (2, "Released under the MIT License.\nReleased under the MIT license. ALL RIGHTS RESERVED", "en"),
            (3, "Permission is hereby granted, without a licence.", "en"), (4, None, "en"), (5, "", "en"),
            (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0!", "en"), (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0!", "en"),
            (None, "Released under the MIT License.", "en"), (None, None, "en"), (8, "the license\n" * 5000 + "license " * 20_000, "en")]
    got = sorted(((str(r.doc_id), r.sequence, r.n_sentences, r.licences) for r in license.scan(frame(spark, full)).collect()), key=repr)
    assert got == sorted([("1", "apache.name", 1, ["Apache-2.0"]), ("2", "short.MIT short.MIT rights", 3, ["All-rights-reserved", "MIT"]), ("3", "", 0, []),
                          ("4", "", 0, []), ("5", "", 0, []), *[("6", "short.CC-BY-NC-4.0 short.CC-BY-4.0", 2, ["CC-BY-4.0", "CC-BY-NC-4.0"])] * 2,
                          ("None", "short.MIT", 1, ["MIT"]), ("None", "", 0, []), ("8", "", 0, [])], key=repr)
    found = {str(r.doc_id): r.licences for r in license.scan(edge).collect()}
    assert found["15"] == ["All-rights-reserved", "Apache-2.0"] and sum(map(bool, found.values())) == 1
    assert license.scan(frame(spark, [])).count() == 0
