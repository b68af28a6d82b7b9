"""Licence scan by sentence rules (operator 7); DataFrame functions only.

A text is read in lines.  Comment leaders are dropped; a blank line, or an end mark (. ! ?) before
white space, ends a sentence, a plain line break does not ("v. 2" is no end).  Each line is
normalised (lower case, anything but ASCII letters and digits is one space).  A sentence is any
run of lines, and parts of lines between end marks, that crosses no sentence end; it is looked up
in a fixed table of known licence sentences, so a notice is found wrapped at any width, on one
line, or behind comment marks.  Runs are tried only from lines that begin as a known sentence
does, and only as long as the longest known one.

The identifiers of the known sentences, in text order (of several that begin at one place, the
longest), form the document's sequence; a licence rule is a sequence of identifiers that must
follow each other there.  Rules are ordered: one of more sentences comes first, and its sentences
do not count again for a shorter one.

The known sentences are a constant table, broadcast; nothing else is.  Documents without any
of the anchor words are not cut; each known sentence has one of them.

Edge cases: null and empty texts have no licence; repeated sentences count each time they occur,
a licence is listed once; a row with a null id is scanned like any other; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and sentence as published (punctuation and case do not matter).
SENTENCES = [
    ("apache.grant", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache.name", "Licensed under the Apache License, Version 2.0"),
    ("apache.name", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache.asf", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("apache.asf2", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                    "compliance with the License"),
    ("apache.comply", "you may not use this file except in compliance with the License"),
    ("apache.copy", "You may obtain a copy of the License at"),
    ("apache.url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache.url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache.copyurl", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache.asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
                    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache.see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit.grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
                  '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
                  "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                  "subject to the following conditions:"),
    ("mit.notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit.asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
                 "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("isc.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                  "the above copyright notice and this permission notice appear in all copies"),
    ("isc.grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
                  "the above copyright notice and this permission notice appear in all copies"),
    ("0bsd.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd.grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                  "conditions are met:"),
    ("bsd.source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd.binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
                   "the documentation and/or other materials provided with the distribution"),
    ("bsd.names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                  "this software without specific prior written permission"),
    ("bsd.names", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this "
                  "software without specific prior written permission"),
    ("bsd.advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("gpl.2plus", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                  "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl.2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
              "published by the Free Software Foundation"),
    ("gpl.3plus", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                  "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl.3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
              "the Free Software Foundation, version 3"),
    ("agpl.3plus", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl.21plus", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl.3plus", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl.3plus", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl.work3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl.20", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl.copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl.copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl.11", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
               "compliance with the License"),
    ("epl.20", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
               "https://www.eclipse.org/legal/epl-2.0/"),
    ("epl.10", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl.10", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
               "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("cddl.10", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")'),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib.asis", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib.grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
                   "redistribute it freely, subject to the following restrictions:"),
    ("boost.short", "Distributed under the Boost Software License, Version 1.0"),
    ("boost.grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
                    "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to "
                    "the following:"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
            "public domain worldwide"),
    ("rights", "All rights reserved"),
]
# Licence, sentences that must follow each other.
RULES = [
    ("Apache-2.0", "apache.grant apache.copy apache.url apache.asis apache.see"), ("Apache-2.0", "apache.grant apache.copyurl apache.asis apache.see"),
    ("Apache-2.0", "apache.asf apache.asf2"), ("BSD-4-Clause", "bsd.grant bsd.source bsd.binary bsd.advert bsd.names"),
    ("BSD-3-Clause", "bsd.grant bsd.source bsd.binary bsd.names"), ("BSD-2-Clause", "bsd.grant bsd.source bsd.binary"),
    ("MIT", "mit.grant mit.notice mit.asis"), ("BSD-3-Clause", "bsd.grant bsd.names"), ("MIT", "mit.grant mit.notice"), ("Zlib", "zlib.asis zlib.grant"),
    ("MPL-2.0", "mpl.20 mpl.copy"), ("MIT-0", "mit.grant mit.asis"), ("Apache-2.0", "apache.grant"), ("Apache-2.0", "apache.name"),
    ("Apache-2.0", "apache.asf2"), ("MIT", "mit.grant"), ("ISC", "isc.grant"), ("0BSD", "0bsd.grant"), ("BSD-2-Clause", "bsd.grant"),
    ("GPL-2.0-or-later", "gpl.2plus"), ("GPL-2.0-only", "gpl.2"), ("GPL-3.0-or-later", "gpl.3plus"), ("GPL-3.0-only", "gpl.3"), ("GPL-3.0", "gpl.work3"),
    ("AGPL-3.0-or-later", "agpl.3plus"), ("LGPL-2.1-or-later", "lgpl.21plus"), ("LGPL-3.0-or-later", "lgpl.3plus"), ("MPL-2.0", "mpl.20"), ("MPL-1.1", "mpl.11"),
    ("EPL-2.0", "epl.20"), ("EPL-1.0", "epl.10"), ("CDDL-1.0", "cddl.10"), ("Unlicense", "unlicense"), ("Zlib", "zlib.grant"), ("BSL-1.0", "boost.short"),
    ("BSL-1.0", "boost.grant"), ("WTFPL", "wtfpl"), ("CC0-1.0", "cc0"), ("All-rights-reserved", "rights"),
]
# Licence and the names by which short forms call it.
NAMES = [
    ("MIT", ["MIT", "MIT License"]), ("Apache-2.0", ["Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License, Version 2.0"]),
    ("BSD-3-Clause", ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License"]), ("BSD-2-Clause", ["BSD-2-Clause", "BSD 2-Clause License"]),
    ("ISC", ["ISC License", "ISC"]), ("GPL-2.0", ["GPL-2.0", "GPLv2", "GNU General Public License, version 2", "GNU General Public License v2.0"]),
    ("GPL-3.0", ["GPL-3.0", "GPLv3", "GNU General Public License, version 3", "GNU General Public License v3.0"]),
    ("LGPL-2.1", ["LGPL-2.1", "GNU Lesser General Public License, version 2.1"]), ("LGPL-3.0", ["LGPL-3.0", "GNU Lesser General Public License, version 3"]),
    ("AGPL-3.0", ["AGPL-3.0", "GNU Affero General Public License, version 3"]), ("MPL-2.0", ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0"]),
    ("EPL-2.0", ["EPL-2.0", "Eclipse Public License 2.0"]), ("Unlicense", ["Unlicense", "The Unlicense"]), ("Zlib", ["Zlib", "zlib License"]),
    ("BSL-1.0", ["BSL-1.0", "Boost Software License 1.0"]), ("WTFPL", ["WTFPL"]), ("Artistic-2.0", ["Artistic-2.0", "Artistic License 2.0"]),
    ("CC0-1.0", ["CC0-1.0", "CC0 1.0"]), ("0BSD", ["0BSD"]), ("EUPL-1.2", ["EUPL-1.2", "European Union Public Licence 1.2"]),
    ("OFL-1.1", ["OFL-1.1", "SIL Open Font License, Version 1.1"]),
]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
OPENINGS = ["Released under the {} license", "Licensed under the {} license", "Distributed under the {} license", "Available under the {} license",
            "Licensed under {}", "Released under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}",
            "This project is licensed under the {}", "SPDX-License-Identifier: {}"]


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\b([Vv])\.(\s+[0-9])", r"\1\2", sentence).lower()).strip()


def known() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Normalised sentence -> identifier, and the ordered rules (licence, identifiers)."""
    table, rules = {plain(s): i for i, s in SENTENCES}, list(RULES)
    names = [*NAMES]
    for version in ("4.0", "3.0"):
        for code, words in CREATIVE.items():
            names.append((f"CC-{code}-{version}", [f"CC {code} {version}", f"CC-{code}-{version}", f"Creative Commons {words} {version} International License",
                                                   f"Creative Commons {words} {version} International License https://creativecommons.org/licenses/{code.lower()}/{version}/",
                                                   f"Creative Commons {words} {version} Unported License"]))
    for licence, forms in names:
        for form in forms:
            for opening in ([*OPENINGS, "This work is licensed under a {}"] if "Creative" in form else OPENINGS):
                text = plain(opening.format(form)).replace("license license", "license")
                table.setdefault(text, f"short.{licence}")
        rules.append((licence, f"short.{licence}"))
    return table, sorted(rules, key=lambda r: -r[1].count(" "))


HARD = "\x02"                          # stands at the end of a line that ends a sentence
LEADER = "(?m)^[ \\t]*(?://+!?|/\\*+!?|\\*+/?|#+|;+|--+|%+|<!--+|dnl\\b|REM\\b|\"\"\"|''')+[ \\t]*"
TRAILER = "(?m)[ \\t]*(?:\\*+/|--+>)[ \\t]*$"


def lines(text: Column) -> Column:
    """Array of (words, hard): the normalised parts of the text, and whether a sentence ends after them."""
    t = F.regexp_replace(text, "\\r\\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, LEADER, ""), TRAILER, "")
    t = F.regexp_replace(t, "\\b([Vv])\\.(\\s+[0-9])", "$1$2")
    t = F.regexp_replace(t, "[.!?]+(\\s|$)", f"{HARD}\n$1")
    t = F.regexp_replace(t, "\\n[ \\t]*(?=\\n)", f"{HARD}\n")
    parts = F.transform(F.split(t, "\n"), lambda p: F.struct(
        F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")).alias("words"), F.contains(p, F.lit(HARD)).alias("hard")))
    return F.filter(parts, lambda p: (p["words"] != "") | p["hard"])


# Words by which a text is cut at all, the rarer ones first; they may not hold a blank, since lines wrap.
ANCHORS = ["unencumbered", "noninfringement", "redistribut", "acknowledgement", "warranty", "permission", "licen[cs]e", "rights"]


def anchors(sentences: Iterable[str]) -> str:
    """A pattern that every text with a known sentence matches (in lower case): the anchors, and the longest word of
    each sentence that has none of them."""
    some = re.compile("|".join(ANCHORS))
    return "|".join([*ANCHORS, *sorted({max(s.split(" "), key=len) for s in sentences if not some.search(s)})])


def opening(words: Column) -> Column:
    """The first word, by which lines are picked that may begin a known sentence."""
    return F.substring_index(words, " ", 1)


def known_sequences(rows: DataFrame) -> DataFrame:
    """id, row, sequence (identifiers between blanks) of each (id, row, text) with a known sentence."""
    table, _ = known()
    spark = rows.sparkSession
    sentences = spark.createDataFrame(sorted(table.items()), "sentence string, code string")
    most_words = max(s.count(" ") + 1 for s in table)
    most_chars = max(map(len, table))
    first = sorted({s.split(" ")[0] for s in table})
    # a run of lines longer than the longest known sentence cannot be one: what is cut off cannot match
    cut = (rows.where(F.lower("text").rlike(anchors(table))).select("id", "row", lines(F.col("text")).alias("p")).where(F.size("p") > 0)
           .select("id", "row", F.transform("p", lambda x: F.struct(F.substring(x["words"], 1, most_chars + 1).alias("words"), x["hard"].alias("hard"))).alias("p")))
    starts = cut.select("id", "row", "p", F.explode(F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: opening(F.element_at("p", i)["words"]).isin(first))
                                                    ).alias("at"))
    ahead = starts.select("id", "row", "at", F.slice("p", F.col("at"), F.lit(most_words)).alias("p"))
    runs = F.aggregate("p", F.struct(F.lit("").alias("now"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("all")),
                       lambda a, x: F.when(a["over"], a).otherwise(F.struct(
                           F.trim(F.concat(a["now"], F.lit(" "), x["words"])).alias("now"),
                           (x["hard"] | (F.length(a["now"]) + F.length(x["words"]) > most_chars)).alias("over"),
                           F.array_append(a["all"], F.trim(F.concat(a["now"], F.lit(" "), x["words"]))).alias("all"))), lambda a: a["all"])
    tried = ahead.select("id", "row", "at", F.explode(runs).alias("sentence"))
    # rows with equal id and text have equal sequences: a place counts once
    found = tried.join(F.broadcast(sentences), "sentence").groupBy("id", "row", "at").agg(F.max_by("code", F.length("sentence")).alias("code"))
    return (found.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("s"))
            .select("id", "row", F.concat(F.lit(" "), F.array_join("s.code", " "), F.lit(" ")).alias("sequence")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sequence, n_sentences (known ones), licences (by the rules, sorted) for each row."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    sequences = known_sequences(own).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "sequence")
    left, found = F.coalesce("sequence", F.lit("")), []
    for name, codes in known()[1]:
        found.append(F.when(left.contains(f" {codes} "), F.lit(name)))
        if " " in codes:
            left = F.replace(left, F.lit(f" {codes} "), F.lit(" | "))
    return (own.drop("text").join(sequences, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
            .select(F.col("id").alias(id_col), F.trim(F.coalesce("sequence", F.lit(""))).alias("sequence"),
                    F.size(F.filter(F.split(F.coalesce("sequence", F.lit("")), " "), lambda c: c != "")).cast("long").alias("n_sentences"),
                    F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("licences")))
