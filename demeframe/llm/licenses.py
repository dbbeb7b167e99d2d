"""Licence scan: a generalised suffix automaton of licence words.

The automaton holds every word sequence of the templates.  A document's words
stream through it and leave at each word the length of the longest template
sequence that ends there (matching statistics).  Words outside the templates'
vocabulary reset it, so only runs of known words are walked.  Maximal long
matches of one template are chained in order into covered spans.

One scan without a shuffle; the templates are a fixed, small parameter.

Defined results.  Null text counts as empty: no words, no labels, score 0.
Repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of public licences' grants and notices, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU
        Lesser General Public License for more details.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}
#: Words of a match that counts, words between two matches of one chain, and the share of a template that gives its label.
LONG_MATCH, CHAIN_GAP, LABEL_SHARE = 6, 12, 0.3
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found array<struct<label:string,start:long,end:long,words:long,share:double>>"


class SuffixAutomaton:
    """Of several sequences of integers.  ``ends[state]`` has every (sequence, end) of the state's longest string."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of ``q`` that are one longer than ``p``'s."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:  # an earlier sequence has this string
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def statistics(self, words: list[int]) -> tuple[list[int], list[int]]:
        """For each word the longest length of a string that ends there, and its state."""
        lengths, states = [], []
        state = length = 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            lengths.append(length)
            states.append(state)
        return lengths, states


class Scanner:
    """Base phrases and template spans in words."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, long_match: int = LONG_MATCH, gap: int = CHAIN_GAP) -> None:
        self.ids: dict[bytes, int] = {}
        number = lambda text: [self.ids.setdefault(w, len(self.ids) + 1) for w in common.alnum_words(text.encode())]
        self.labels = list(templates)
        sequences = [number(t) for t in templates.values()]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.phrases = [(np.array(number(p)), label) for p, label in phrases.items()]
        self.long_match, self.gap = long_match, gap

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, itertools.repeat(0)), np.int64, len(words))

    def base(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        """Starts of all phrases in order, and their labels."""
        starts, labels = [], set()
        for phrase, label in self.phrases:
            n = len(phrase)
            at = np.flatnonzero(ids[: max(0, len(ids) - n + 1)] == phrase[0])
            for j in range(1, n):
                at = at[ids[at + j] == phrase[j]]
            if len(at):
                starts += at.tolist()
                labels.add(label)
        return sorted(starts), labels

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, words, share of the template) of each chain of long matches."""
        known = np.concatenate(([False], ids > 0, [False]))
        begin, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a < self.long_match:
                continue
            lengths, states = self.automaton.statistics(ids[a:b].tolist())
            for i, n in enumerate(lengths):
                # maximal: the next word doesn't make it longer
                if n >= self.long_match and (i + 1 == len(lengths) or lengths[i + 1] <= n):
                    for template, stop in self.automaton.ends[states[i]]:
                        matches.setdefault(template, []).append((a + i + 1 - n, a + i + 1, stop - n))
        out = []
        for template, found in matches.items():
            chain: list[list[int]] = []
            for start, stop, place in sorted(found):
                words = stop - start
                if chain:
                    last = chain[-1]
                    cut = max(0, last[1] - start, last[2] - place)  # only what both the text and the template have not yet had
                    if cut < words and start + cut - last[1] <= self.gap:
                        last[1], last[2], last[3] = stop, place + words, last[3] + words - cut
                        continue
                    if start < last[1] and words <= last[3]:
                        continue  # another place of the same words
                chain.append([start, stop, place + words, words])
            out += [(self.labels[template], s, e, n, min(1.0, n / self.sizes[template])) for s, e, _, n in chain]
        return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def _scan() -> Callable[[pa.Table], pa.Table]:
    scanner = Scanner()
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("share", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        out = {x: [] for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "found")}
        for text in table.column("text").to_pylist():
            ids = scanner.numbers(common.alnum_words(text or b""))
            starts, labels = scanner.base(ids)
            out["n_words"].append(len(ids))
            out["n_base"].append(len(starts))
            out["first_word"].append(starts[0] if starts else None)
            out["last_word"].append(starts[-1] if starts else None)
            out["base_labels"].append(sorted(labels))
            out["found"].append([dict(zip(("label", "start", "end", "words", "share"), x, strict=True)) for x in scanner.spans(ids)])
        kinds = dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64()) | {"base_labels": pa.list_(pa.string()), "found": pa.list_(span)}
        return pa.table({"doc_id": table.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def license_spans(docs: DataFrame) -> DataFrame:
    """Base phrases' places and labels, and the template spans ``found`` (words, half-open)."""
    common.arrow_limits(docs.sparkSession)
    return common.map_tables(common.doc_bytes(docs), _scan, SCHEMA, 4 << 20)


def labelled(spans: DataFrame) -> DataFrame:
    """Labels as text; a template gives its label from LABEL_SHARE of its words in one span on."""
    strong = F.transform(F.filter("found", lambda x: x["share"] >= LABEL_SHARE), lambda x: x["label"])
    labels = F.array_join(F.array_sort(F.array_union("base_labels", strong)), ",")
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return spans.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), labels.alias("labels"), score.alias("score"), "found")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(license_spans(common.read_table(spark, sf_dir, "documents")))
