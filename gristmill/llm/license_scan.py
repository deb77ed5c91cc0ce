"""Licence scans with a generalised suffix automaton of licence tokens.

The templates are short public notices. Their token sequences build one automaton; a text streams through it once and
gives, at every token, the length of the longest suffix that is part of a template (matching statistics). Its suffix links
lead to the shorter suffixes and with them to every place of every template that a match ends at, so no template hides
another. Long matches are chained in order on both sides; a chain that covers enough of its template labels the span;
where templates of a family share their words, the one that covers most of them does. Tokens whose neighbours never meet
in a template reset the automaton, so they are skipped ahead of it by a table of template bigrams, which changes no
match of three tokens or more.

Documents are read once, stay where they are, and are scanned whole.

Defined results: a null text is an empty one and has no words; a repeated row is scanned again; other columns are not
looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table

#: Phrases of the base result, fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: SPDX identifiers by label, fixed values; each is a template as a file header and, where it has three words, by itself.
SPDX = {
    "mit": ("MIT", "MIT-0"), "apache-2.0": ("Apache-2.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"), "isc": ("ISC",), "zlib": ("Zlib",), "bsl-1.0": ("BSL-1.0",),
    "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",), "cc0": ("CC0-1.0",), "cc-by": ("CC-BY-4.0", "CC-BY-3.0"), "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"), "cc-by-nc": ("CC-BY-NC-4.0",),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "epl-2.0": ("EPL-2.0",),
}

#: Paragraphs of public licence texts, fixed values.
PARAGRAPHS = (
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "either version 2 of the License, or (at your option) any later version. GNU General Public License"),
    ("lgpl", "See the GNU Lesser General Public License for more details."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)

#: (label, notice). Short forms of public licence notices.
NOTICES = (
    ("mit", "licensed under the terms of the MIT license"),
    ("mit", "under the MIT license"),
    ("gpl", "GNU GPL v3"),
    ("gpl", "GNU GPL v2"),
    ("gpl", "GNU GPL version 3"),
    ("gpl", "GNU GPL version 2"),
    ("lgpl", "GNU LGPL v3"),
    ("agpl", "GNU AGPL v3"),
    ("reserved", "All rights reserved."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _spdx() -> tuple[tuple[str, str], ...]:
    named = [(label, name) for label, names in SPDX.items() for name in names]
    return tuple((label, f"SPDX-License-Identifier: {name}") for label, name in named) + tuple((label, name) for label, name in named if len(words_of(name)) >= LEAST)

#: Shortest match that a chain may use, in tokens.
LEAST = 3
#: Tokens between two matches of a chain, at most.
GAP = 8
#: Share of a template that its chain must cover.
COVER = 0.8

_STRETCH = 64
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split()


TEMPLATES = NOTICES + PARAGRAPHS + _spdx()


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int]
    ends: set[tuple[int, int]] = field(default_factory=set)


class SuffixAutomaton:
    """Generalised over several token sequences; a state knows every place where its factors end."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [State(0, -1, {})]
        self.sequences = sequences
        for number, sequence in enumerate(sequences):
            last = 0
            for position, token in enumerate(sequence):
                last = self._extend(last, token)
                self.states[last].ends.add((number, position))
        for s in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            if self.states[s].link > 0:
                self.states[self.states[s].link].ends |= self.states[s].ends

    def _clone(self, p: int, q: int, token: int) -> int:
        states = self.states
        copy = len(states)
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = copy
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = copy
            p = states[p].link
        return copy

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        q = states[last].next.get(token)
        if q is not None:
            return q if states[q].length == states[last].length + 1 else self._clone(last, q, token)
        new = len(states)
        states.append(State(states[last].length + 1, 0, {}))
        p = last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, token)
        return new

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, template, end in the template) of the matches of ``least`` tokens or more that neither side extends."""
        states, s, length = self.states, 0, 0
        for i, token in enumerate(tokens):
            while s and token not in states[s].next:
                s = states[s].link
                length = states[s].length
            if token not in states[s].next:
                continue
            s = states[s].next[token]
            length += 1
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            at, suffix, seen = s, length, set()
            while suffix >= least:
                # a place that a longer suffix has ended at is no match of its own
                for place in states[at].ends - seen:
                    template, position = place
                    sequence = self.sequences[template]
                    if position + 1 == len(sequence) or sequence[position + 1] != after:
                        yield i + 1, suffix, template, position + 1
                seen = states[at].ends
                at = states[at].link
                suffix = states[at].length if at > 0 else 0


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text) for _, text in templates]
        phrases = [(words_of(phrase), label) for phrase, label in PHRASES]
        self.vocabulary: dict[bytes, int] = {}
        for sequence in [*sequences, *(p for p, _ in phrases)]:
            for word in sequence:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.lengths = [len(s) for s in sequences]
        coded = [[self.vocabulary[w] for w in s] for s in sequences]
        self.phrases = [([self.vocabulary[w] for w in p], label) for p, label in phrases]
        self.automaton = SuffixAutomaton(coded)
        n = len(self.vocabulary) + 1  # the last id stands for any other word
        self.other = n - 1
        self.pairs = np.zeros((n, n), dtype=bool)
        for c in coded:
            self.pairs[c[:-1], c[1:]] = True

    def code(self, words: list[bytes]) -> np.ndarray:
        get, other = self.vocabulary.get, self.other
        return np.fromiter([get(w, other) for w in words], dtype=np.int64, count=len(words))

    def base(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """The places of each phrase, by label."""
        found = {}
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = ids[:n] == phrase[0]
                for k, word in enumerate(phrase[1:], 1):
                    hit &= ids[k : k + n] == word
                if hit.any():
                    found[label] = np.flatnonzero(hit)
        return found

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first token, end token, share covered) of the chains that cover enough of their template."""
        if len(ids) < LEAST:
            return []
        met = self.pairs[ids[:-1], ids[1:]]
        long = met[:-1] & met[1:] if LEAST > 2 else met
        if not long.any():
            return []
        inside = np.zeros(len(ids), dtype=bool)
        at = np.flatnonzero(long)
        for k in range(LEAST):
            inside[at + k] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for end, length, template, position in self.automaton.matches(ids[start:stop].tolist(), LEAST):
                by_template.setdefault(template, []).append((start + end - length, position - length, length))
        found = []
        for template, matches in by_template.items():
            found += self._chains(template, sorted(matches))
        return sorted(self._apart(found), key=lambda x: (x[1], x[2], x[0]))

    @staticmethod
    def _apart(found: list[tuple[str, int, int, float, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Of the templates that share words (those of one family do), the one that covers the most words of a span stays."""
        taken: dict[int, list[tuple[int, int]]] = {}  # by stretch of the text, so that a span meets only its neighbours
        for label, a, b, share, _ in sorted(found, key=lambda x: (-x[4], -x[3], x[1], x[0])):
            stretches = range(a // _STRETCH, (b - 1) // _STRETCH + 1)
            if all(2 * (min(b, d) - max(a, c)) <= min(b - a, d - c) for k in stretches for c, d in taken.get(k, ())):
                for k in stretches:
                    taken.setdefault(k, []).append((a, b))
                yield label, a, b, share

    def _chains(self, template: int, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float, int]]:
        """Best chains of matches in order on both sides; each match ends one, and the best of a region counts."""
        best: list[tuple[int, int, int]] = []  # covered, start, end
        for i, (at, on, length) in enumerate(matches):
            top = (length, at, at + length)
            for j in range(i - 1, -1, -1):
                a, o, n = matches[j]
                if at - best[j][2] > GAP + self.lengths[template]:
                    break
                # what two matches share on either side counts once
                fresh = length - max(0, a + n - at, o + n - on)
                if a < at and o < on and fresh > 0 and at <= a + n + GAP and on <= o + n + GAP and best[j][0] + fresh > top[0]:
                    top = (best[j][0] + fresh, best[j][1], at + length)
            best.append(top)
        starts: list[int] = []
        ends: list[int] = []
        for covered, start, end in sorted(best, key=lambda x: (-x[0], x[1])):
            share = covered / self.lengths[template]
            if share < COVER:
                break
            k = bisect.bisect_left(starts, end)
            if not k or ends[k - 1] <= start:
                starts.insert(k, start)
                ends.insert(k, end)
                yield self.labels[template], start, end, min(1.0, share), covered


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans string"
)


def scan_text(scanner: Scanner, text: str | None) -> tuple:
    ids = scanner.code(words_of(text))
    base, spans = scanner.base(ids), scanner.spans(ids)
    places = np.concatenate(list(base.values())) if base else None
    score = max([s[3] for s in spans] + [1.0] * bool(base), default=0.0)
    return (
        len(ids),
        0 if places is None else len(places),
        None if places is None else int(places.min()),
        None if places is None else int(places.max()),
        ",".join(sorted(base)),
        ",".join(sorted({*base, *(s[0] for s in spans)})),
        score,
        ",".join(f"{label}:{a}:{b}" for label, a, b, _ in spans),
    )


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in rows:
        out = [scan_text(scanner, text.as_py()) for text in batch.column(1)]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; ``spans`` has label:first:end of the covered templates, in tokens."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
