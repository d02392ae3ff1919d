"""License scans by sentence rules.

A text is cut into sentences, each is normalised (case, punctuation, comment marks, line
breaks, spelling of "licence"; version numbers become a slot) and looked up among known
licence sentences, which gives an identifier with the versions it mentions.  The sequence
of identifiers is matched against rules, in order, the more specific first; a rule takes
the identifiers that it matches.  Identifiers that no rule takes are reported as loose, and
so are sentences that put something under a licence which isn't known.

Sentences are those of the licences' own texts, SPDX tags with whole expressions, and
notices made by rule: a phrase ("licensed under"), a name of a licence, an ending.

A sentence ends at a full stop (but that of "v."), question or exclamation mark before white space, at a colon
before a line's end, or at an empty line.  A line break inside a sentence may also be a boundary: the longest run of
whole lines that is a known sentence counts.  Words are looked up one by one among the beginnings of known
sentences, so a text costs its length, however many lines a sentence has.

Cases: null and empty texts have no licences; whole texts are scanned; lines without words
count for nothing; repeated passages are reported each time; a rule's sentences may have at
most ``GAP`` unknown sentences between them; repeated rows give repeated rows; only the id
and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, text_of

#: Unknown sentences that may stand between two sentences of one rule.
GAP = 2

#: Identifier and licence sentences that it stands for; {v} is a version.
SENTENCES = {
    "mit-name": ["The MIT License", "The MIT License (MIT)"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-name": ['Licensed under the Apache License, Version {v} (the "License")'],
    "apache-may": ["you may not use this file except in compliance with the License", 'Licensed under the Apache License, Version {v} (the "License"); you may not use this file except in compliance with the License'],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version"],
    "gpl-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {v} as published by the Free Software Foundation"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-see": ["See the GNU General Public License for more details"],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU General Public License along with this program; if not, see"],
    "lgpl-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version"],
    "agpl-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"],
    "agpl-see": ["See the GNU Affero General Public License for more details"],
    "mpl-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl-name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{v}"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-name": ["Distributed under the Boost Software License, Version {v}"],
    "bsd-intro": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "cc0": ["This work is dedicated to the public domain under CC0 {v}"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
#: How notices begin and end, and names of licences that stand between.
PHRASES = ["Licensed under", "Released under", "Distributed under", "Available under", "Made available under", "Published under"]
SUBJECTS = ["This project is", "This work is", "This program is", "This software is", "This library is", "This package is", "This file is", "The code is", "The project is", "This code is"]
ENDINGS = ["", "see the LICENSE file for details", "see LICENSE for details", "see the LICENSE file for more information", "see LICENSE", "see the file LICENSE for details"]
NAMES = {
    "mit-name": ["the MIT License", "MIT License", "the MIT License (MIT)", "the MIT", "MIT", "the terms of the MIT License"],
    "apache-name": ["the Apache License, Version {v}", "the Apache License {v}", "Apache License {v}", "Apache {v}", "the Apache {v} License", "the Apache License", "Apache License, Version {v}", "the terms of the Apache License, Version {v}"],
    "gpl-name": ["the GNU General Public License, version {v}", "the GNU General Public License v{v}", "the GNU GPL v{v}", "the GPL v{v}", "the GPLv{v}", "GPLv{v}", "the GNU GPL version {v}", "the terms of the GNU General Public License, version {v}", "the GNU General Public License"],
    "lgpl-name": ["the GNU Lesser General Public License, version {v}", "the GNU Lesser General Public License v{v}", "the GNU LGPL v{v}", "the LGPL v{v}", "LGPLv{v}", "the LGPLv{v}", "the GNU Lesser General Public License"],
    "agpl-name": ["the GNU Affero General Public License, version {v}", "the GNU Affero General Public License v{v}", "the GNU AGPL v{v}", "the AGPL v{v}", "AGPLv{v}", "the AGPLv{v}"],
    "mpl-name": ["the Mozilla Public License, version {v}", "the Mozilla Public License {v}", "the MPL {v}", "MPL {v}", "the terms of the Mozilla Public License, v. {v}"],
    "epl-name": ["the Eclipse Public License {v}", "the Eclipse Public License v{v}", "the Eclipse Public License, version {v}", "EPL {v}"],
    "bsd-name": ["the {v}-Clause BSD License", "the BSD {v}-Clause License", "the BSD {v}-Clause", "BSD {v}-Clause", "BSD-{v}-Clause"],
    "isc-name": ["the ISC License", "ISC License", "ISC"],
    "zlib-name": ["the zlib License", "the zlib/libpng License", "zlib License"],
    "boost-name": ["the Boost Software License, Version {v}", "the Boost Software License {v}"],
    "unlicense": ["the Unlicense", "Unlicense"],
    "cc-by": ["CC BY {v}", "a Creative Commons Attribution {v} International License", "the Creative Commons Attribution {v} License"],
    "cc-by-sa": ["CC BY-SA {v}", "a Creative Commons Attribution-ShareAlike {v} International License"],
    "cc-by-nc": ["CC BY-NC {v}", "a Creative Commons Attribution-NonCommercial {v} International License"],
    "cc-by-nd": ["CC BY-ND {v}", "a Creative Commons Attribution-NoDerivatives {v} International License"],
    "cc-by-nc-sa": ["CC BY-NC-SA {v}", "a Creative Commons Attribution-NonCommercial-ShareAlike {v} International License"],
    "cc-by-nc-nd": ["CC BY-NC-ND {v}", "a Creative Commons Attribution-NonCommercial-NoDerivatives {v} International License"],
    "cc0": ["CC0 {v}"],
}
#: A tag whose expression names the licences itself.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)")
#: What puts something under a licence.
UNDER = re.compile(r"\b(?:licen[sc]ed|released|distributed|(?:made )?available)\s+under\s+(?:\S+\s+){0,8}?licen[sc]e", re.IGNORECASE)
UNKNOWN = "unknown-notice"
#: Rules in order: licence and the identifiers that stand for it.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-{v}", ["apache-may", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-{v}", ["apache-name", "apache-may", "apache-copy"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-intro", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("AGPL-{v}-or-later", ["agpl-later", "gpl-hope", "agpl-see"]),
    ("AGPL-{v}-or-later", ["agpl-later"]),
    ("MPL-{v}", ["mpl-name", "mpl-copy"]),
    ("GPL-{v}-or-later", ["gpl-later", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("GPL-{v}-only", ["gpl-only", "gpl-hope", "gpl-see"]),
    ("GPL-{v}-or-later", ["gpl-later"]),
    ("GPL-{v}-only", ["gpl-only"]),
    ("LGPL-{v}-or-later", ["lgpl-later"]),
    ("GPL-{v}", ["gpl-name"]),
    ("LGPL-{v}", ["lgpl-name"]),
    ("AGPL-{v}", ["agpl-name"]),
    ("MPL-{v}", ["mpl-name"]),
    ("EPL-{v}", ["epl-name"]),
    ("BSL-{v}", ["boost-name"]),
    ("Zlib", ["zlib-grant"]),
    ("Zlib", ["zlib-name"]),
    ("ISC", ["isc-name"]),
    ("Apache-{v}", ["apache-name"]),
    ("Apache-{v}", ["apache-may"]),
    ("MIT", ["mit-name"]),
    ("BSD-{v}-Clause", ["bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("CC-BY-NC-SA-{v}", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-{v}", ["cc-by-nc-nd"]),
    ("CC-BY-NC-{v}", ["cc-by-nc"]),
    ("CC-BY-SA-{v}", ["cc-by-sa"]),
    ("CC-BY-ND-{v}", ["cc-by-nd"]),
    ("CC-BY-{v}", ["cc-by"]),
    ("CC0-{v}", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("proprietary", ["reserved"]),
    ("{v}", ["spdx-tag"]),
]

_VERSION = re.compile(r"\d+(?:\.\d+)*")
_WORD = re.compile(r"\{v\}|\d+(?:\.\d+)*|[^\W\d_]+")
#: A sentence in which this isn't found is no licence sentence.
TRIGGER = re.compile(r"licen[sc]e|permi(?:ssion|tted)|redistribut|as.is\b|copyright|public domain|rights reserved|free software|under (?:the |gpl|mit|cc|bsd|apache|l?gpl|agpl|isc|mpl|epl)|in the hope that|no event|warranty|accompanying materials|of the mpl", re.IGNORECASE)


def words_of(sentence: str) -> list[tuple[str, str | None]]:
    """The words of a sentence, each with the version that it is, if any: that leaves a slot."""
    out = []
    for w in _WORD.findall(sentence.lower()):
        if _VERSION.fullmatch(w):
            out.append(("{v}", w))
        else:
            out.append(("licens" + w[6:] if w.startswith("licenc") else w, None))
    return out


def notices() -> Iterator[tuple[str, str]]:
    """Identifier and sentence of every notice that phrases, names and endings make."""
    openings = [*PHRASES, *(f"{x} {p.lower()}" for x in SUBJECTS for p in PHRASES)]
    for name, forms in NAMES.items():
        for opening, form, ending in product(openings, forms, ENDINGS):
            yield name, f"{opening} {form} {ending}"


def known() -> dict[str, dict]:
    """Known sentences as a tree of words; "" leads to the identifier."""
    tree: dict[str, dict] = {}
    for name, sentence in [*notices(), *((n, s) for n, sentences in SENTENCES.items() for s in sentences)]:
        at = tree
        for w, _ in words_of(sentence):
            at = at.setdefault(w, {})
        at[""] = name
    return tree


KNOWN = known()
_END = re.compile(r"(?<!\bv)(?<![.!?])[.!?]++(?=\s|$)|:(?=[ \t]*\n)|\n[ \t]*(?=\n)")
_LINE = re.compile(r"[^\n]+")


def sentences_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """The sentences, each as the places of its lines."""
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        lines = [m.span() for m in _LINE.finditer(text, at, end) if not m[0].isspace()]
        if lines:
            yield lines
        at = end


def identifiers(text: str) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """Number of the sentence, place, identifier and versions of every known sentence."""
    tags = {m.start(): (m.end(1), m[1]) for m in TAG.finditer(text)} if "SPDX" in text else {}
    found = []
    for n, spans in enumerate(sentences_of(text)):
        if not TRIGGER.search(text, spans[0][0], spans[-1][1]):
            continue
        lines = [(s, e, w) for s, e in spans if (w := words_of(text[s:e]))]
        before, i = len(found), 0
        while i < len(lines):
            start, end, _ = lines[i]
            tag = next((t for t in range(start, min(end, start + 40)) if t in tags), None) if tags else None
            if tag is not None:
                found.append((n, start, max(end, tags[tag][0]), "spdx-tag", (tags[tag][1],)))
                i += 1
                continue
            best, at, versions, j = None, KNOWN, [], i
            while j < len(lines) and at is not None:
                for w, version in lines[j][2]:
                    at = at.get(w)
                    if at is None:
                        break
                    if version:
                        versions.append(version)
                else:
                    if "" in at:
                        best = (j, at[""], tuple(versions))
                    j += 1
            if best:
                found.append((n, start, lines[best[0]][1], best[1], best[2]))
                i = best[0]
            i += 1
        if len(found) == before and (m := UNDER.search(text, spans[0][0], spans[-1][1])):
            found.append((n, m.start(), m.end(), UNKNOWN, ()))
    return found


def licenses_of(text: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """The licences with their places, and the identifiers that no rule takes."""
    if not TRIGGER.search(text):
        return [], []
    ids = identifiers(text)
    taken, loose, k = [], [], 0
    while k < len(ids):
        for name, rule in RULES:
            part = ids[k : k + len(rule)]
            if [x[3] for x in part] == rule and all(b[0] - a[0] <= GAP + 1 for a, b in zip(part, part[1:], strict=False)):
                versions = next((x[4] for x in part if x[4]), ())
                taken.append((name.replace("{v}", versions[0] if versions else "any"), part[0][1], part[-1][2]))
                k += len(rule)
                break
        else:
            loose.append(ids[k][3])
            k += 1
    return taken, loose


LICENSE = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``licenses array<struct<name, start, end>>`` and ``loose array<string>``, for every row."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        found = [licenses_of(t) for t in b.column(1).to_pylist()]
        return {
            "licenses": pa.array([[{"name": n, "start": s, "end": e} for n, s, e in x] for x, _ in found], _ARROW),
            "loose": pa.array([x for _, x in found], pa.list_(pa.string())),
        }

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return map_batches(rows, batch, [T.StructField("licenses", T.ArrayType(LICENSE)), T.StructField("loose", T.ArrayType(T.StringType()))], [id_col])


def report(docs: DataFrame) -> DataFrame:
    """Per document the licences by name, how many passages name one, their places, and loose sentences."""
    places = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return scan(docs).select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))), ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_passages"),
        F.array_join(places, ",").alias("spans"),
        F.array_join("loose", ",").alias("loose"),
    )
