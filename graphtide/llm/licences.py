"""Licence recognition by sentences: known sentences become identifiers, sequences of them match rules.

A text is cut into sentences and these into lines; known sentences are found as runs of adjacent lines, over
breaks too, since their own marks or a wrapped line may cut them. A rule is a licence with the sequence of
identifiers that states it. Rules are tried in order, longer ones first, at each place of the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Names that licences go by, as texts state them.
NAMES = {
    "MIT": ["MIT License", "MIT license", "MIT licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "3-clause BSD license"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
#: Sentences that state a licence by name; {} is the name.
STATEMENTS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}", "This file is licensed under the {}", "Distributed under the {}", "Available under the {}", "SPDX-License-Identifier: {}"]

# Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Licence and the sequence of sentence identifiers that states it.
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-notice", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("Unlicense", ["unlicense"]),
]
#: Every known sentence holds one of these stems; a text without any has no licence.
STEMS = re.compile(r"licen|mpl|gpl|permission|redistribut|copyright|warrant|software|(?:available|released|distributed)\W+under", re.IGNORECASE)
_BREAK = re.compile(r"(?<=[.!?:;])[ \t]+(?=[^ \t])|\n{2,}|(?<=[.!?:])\n|\n(?=[ \t]*[*\-\d(])")
_LINE = re.compile(r"[^\n]+")
_BULLET = re.compile(r"\d{1,2}|[a-c]")
_PARTS = re.compile(r"[^a-z0-9.+]+")


def _words(text: str) -> list[str]:
    return [w for x in _PARTS.split(text.lower()) if (w := x.strip("."))]


def normalise(sentence: str) -> str:
    """Lower case, marks as single spaces, no bullet in front, no full stop behind."""
    words = _words(sentence)
    if words and _BULLET.fullmatch(words[0]) and len(words) > 3:
        words = words[1:]
    return " ".join(words)


class Rules:
    """Sentence identifiers by normalised sentence, and rules by first identifier, the longest first."""

    def __init__(self):
        self.ids = {normalise(s): i for i, s in SENTENCES.items()}
        rules = list(TEXT_RULES)
        for licence, names in NAMES.items():
            for name in [*names, licence]:
                for form in STATEMENTS:
                    self.ids.setdefault(normalise(form.format(name)), f"is-{licence}")
            rules.append((licence, [f"is-{licence}"]))
        self.tree: dict = {}  # word -> next words; the identifier of what ends there under ""
        for sentence, i in self.ids.items():
            node = self.tree
            for word in sentence.split():
                node = node.setdefault(word, {})
            node[""] = i
        self.by_first: dict[str, list[tuple[str, list[str]]]] = {}
        for licence, sequence in sorted(rules, key=lambda r: -len(r[1])):
            self.by_first.setdefault(sequence[0], []).append((licence, sequence))

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, start, end) in characters, in order; matches don't overlap."""
        if not STEMS.search(text):
            return []
        # Lines and the number of their sentence: where known sentences may begin and end.
        lines = [(number, m.start(), m.end()) for number, (start, end) in enumerate(sentences(text)) for m in _LINE.finditer(text, start, end)]
        known, at, joined = [], 0, 0  # (identifier, number of the sentence, start, end), what a match covers counts as one
        while at < len(lines):
            if (found := self._longest(text, lines, at)) is None:
                at += 1
                continue
            i, last = found
            known.append((i, lines[at][0] - joined, lines[at][1], lines[last][2]))
            joined += lines[last][0] - lines[at][0]
            at = last + 1
        out, at = [], 0
        while at < len(known):
            for licence, sequence in self.by_first.get(known[at][0], []):
                part = known[at : at + len(sequence)]
                if [p[0] for p in part] == sequence and part[-1][1] - part[0][1] <= 2 * len(sequence):
                    out.append((licence, part[0][2], part[-1][3]))
                    at += len(sequence)
                    break
            else:
                at += 1
        return out


    def _longest(self, text: str, lines: list[tuple[int, int, int]], first: int) -> tuple[str, int] | None:
        """(identifier, last line) of the longest known sentence that begins with a line and ends with one."""
        words = _words(text[lines[first][1] : lines[first][2]])
        for skip in range(2 if words and _BULLET.fullmatch(words[0]) else 1):
            node, best, rest, last = self.tree, None, words[skip:], first
            n = skip
            while True:
                n += len(rest)
                for word in rest:
                    if (node := node.get(word)) is None:
                        break
                if node is None:
                    break
                if "" in node and (n > 3 or not skip):
                    best = node[""], last
                last += 1
                if last == len(lines) or node is self.tree:
                    break
                rest = _words(text[lines[last][1] : lines[last][2]])
            if best:
                return best
        return None


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: they end at marks before white space, at blank lines and before list items; other line
    breaks are inside a sentence."""
    spans, start = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > start:
            spans.append((start, m.start()))
        start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def _scan():
    def run(batches):
        rules = Rules()
        for batch in batches:
            names, starts, ends = [], [], []
            for value in batch.column(1):
                found = rules.scan(value.as_py() or "")
                names.append([f[0] for f in found])
                starts.append([f[1] for f in found])
                ends.append([f[2] for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([len(n) for n in names], pa.int64())],
                ["doc_id", "licences", "starts", "ends", "n_matches"],
            )

    return run


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, starts, ends, n_matches) for each row, matches in order of the text.

    Spans are in characters, ends exclusive. Null and empty texts have no match (empty arrays). Rows come
    out once each, also repeated ones and null ids. An empty table gives an empty result. Whole texts are
    read; other columns are not.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(), "doc_id long, licences array<string>, starts array<long>, ends array<long>, n_matches long")
