"""License scans: matching statistics against a generalised suffix automaton of licence tokens."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_batches
from ._kernel import LOWER, class_table, hash_spans, owners, text_blocks, words

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text in lower case.
WORD_BYTES = ~class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Templates, paragraphs of public licence texts and usual notices, and their labels; a file may hold any one of them without the others.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


@dataclass
class Automaton:
    """Generalised suffix automaton over token numbers.

    Of each state: transitions, suffix link, longest length, and per template the last token's place of the first occurrence (ends) and of each (places).
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])
    places: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        self.places.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        self.ends[clone], self.places[clone] = dict(self.ends[q]), {k: list(x) for k, x in self.places[q].items()}
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int], template: int) -> None:
        last, path = 0, []
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
                last = new
            path.append(last)
        for place in range(len(path)):
            s = 0
            for t in tokens[: place + 1]:
                s = self.next[s][t]
            while s > 0:
                self.ends[s].setdefault(template, place)
                self.places[s].setdefault(template, []).append(place)
                s = self.link[s]

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """At each token the longest suffix read that occurs in a template: (state, length)."""
        state, n, out = 0, 0, []
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if t in self.next[state]:
                state, n = self.next[state][t], n + 1
            out.append((state, n))
        return out


def tokens_of(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    raw = data.tobytes()
    s, e = words(data, np.array([0, len(data)]), WORD_BYTES)
    return [raw[a:b] for a, b in zip(s, e, strict=True)]


@dataclass
class Index:
    """The automaton with all that a scan needs; its size is that of the given templates, whatever the corpus."""

    templates: tuple[tuple[str, str], ...]
    phrases: tuple[tuple[str, str], ...]

    def __post_init__(self):
        lists = [tokens_of(t) for _, t in self.templates]
        phrases = [tokens_of(t) for t, _ in self.phrases]
        self.vocabulary = sorted({w for x in lists + phrases for w in x})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.lists = [[number[w] for w in x] for x in lists]
        self.phrase_lists = [[number[w] for w in x] for x in phrases]
        self.automaton = Automaton()
        for k, x in enumerate(self.lists + self.phrase_lists):
            self.automaton.add(x, k)
        size = len(self.vocabulary)
        self.pairs = np.zeros((size + 1, size + 1), bool)
        for x in self.lists + self.phrase_lists:
            self.pairs[x[:-1], x[1:]] = True
        #: Words that are a phrase or template by themselves; the shortest template.
        self.single = np.zeros(size + 1, bool)
        self.single[[x[0] for x in self.lists + self.phrase_lists if len(x) == 1]] = True
        self.shortest = min(map(len, self.lists), default=1)
        raw = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary])
        hashes = hash_spans(raw, np.concatenate(([0], ends[:-1])), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrase_state = []
        for x in self.phrase_lists:
            s = 0
            for t in x:
                s = self.automaton.next[s][t]
            self.phrase_state.append(s)
        #: Of each state, the phrases that its strings of their length or more end with.
        self.ending = [[] for _ in self.automaton.length]
        for s in range(len(self.ending)):
            up = s
            while up > 0:
                self.ending[s] += [k for k, p in enumerate(self.phrase_state) if p == up]
                up = self.automaton.link[up]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], len(self.hashes))


def chain(index: Index, stats: list[tuple[int, int]], least: int, gap: int, covered: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """Base places (start, end, phrase) of one run; adds its long right-maximal matches to covered by template."""
    found = []
    for i, (s, n) in enumerate(stats):
        for k in index.ending[s]:
            if len(index.phrase_lists[k]) <= n:
                found.append((i + 1 - len(index.phrase_lists[k]), i + 1, k))
        if n >= min(least, index.shortest) and (i + 1 == len(stats) or stats[i + 1][1] <= n):
            for template, places in index.automaton.places[s].items():
                if template < len(index.lists) and n >= min(least, len(index.lists[template])):
                    covered.setdefault(template, []).extend((i + 1 - n, i + 1, place + 1 - n) for place in places)
    return found


def _chains(matches: list[tuple[int, int, int]], size: int, gap: int) -> list[tuple[float, int, int]]:
    """(cover, start, end) of the best chain that ends with each match; one is in order in text and template, at most gap words apart."""
    out, ends = [], []
    for a, b, t in matches:
        mine, start = b - a, a
        for a0, b0, t0, c0, s0 in ends:
            if b0 <= a and a - b0 <= gap and t0 + (b0 - a0) <= t and c0 + b - a > mine:
                mine, start = c0 + b - a, s0
        ends.append((a, b, t, mine, start))
        if len(ends) > 64:  # those out of reach can't be continued
            ends = [x for x in ends if a - x[1] <= gap]
        out.append((min(1.0, mine / size), start, b))
    return out


def template_covers(matches: list[tuple[int, int, int]], size: int, gap: int, cover: float) -> tuple[float, list[tuple[float, int, int]]]:
    """The best cover of a template, and disjoint chains of matches that reach cover: best ones first, until the matches beside them make none."""
    left, best, spans = sorted(set(matches)), 0.0, []
    while left:
        found = sorted(_chains(left, size, gap), key=lambda x: (-x[0], x[2] - x[1], x[1]))
        best = max(best, found[0][0])
        if found[0][0] < cover:
            break
        taken: list[tuple[int, int]] = []
        for c, a, b in found:
            at = bisect.bisect(taken, (a, b))
            if c >= cover and (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                spans.append((c, a, b))
        free = lambda a, b: (at := bisect.bisect(taken, (b,))) == 0 or taken[at - 1][1] <= a
        left = [x for x in left if free(x[0], x[1])]
    return best, spans


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, least: int = 3, gap: int = 8, cover: float = 0.6) -> DataFrame:
    """Licences of each whole text.

    Each document's words stream through the automaton; where they reach no two words in a row of any template its state is the root's,
    so those stretches are passed over in bulk; phrases and templates of one word are found wherever they stand.  Right-maximal matches of
    ``least`` words or more, or of a whole shorter template, are chained (gaps up to ``gap`` words)
    and a template gives its label, and a span for each of its disjoint chains that cover ``cover`` of its words; score is the best cover.
    One row per input row (repeated ones too); null and empty texts have no words, labels "" and score 0; further columns are ignored.
    """
    index = Index(tuple(templates), tuple(phrases))
    names = [k for _, k in phrases]

    def batch(b):
        n = b.num_rows
        out = {k: [0] * n for k in ("n_words", "n_base")} | {k: [None] * n for k in ("first_word", "last_word")} | {k: [""] * n for k in ("base_labels", "labels")} | {"score": [0.0] * n, "spans": [[] for _ in range(n)]}
        for i, j, data, offs in text_blocks(b.column(1)):
            low = LOWER[data]
            starts, ends = words(low, offs, WORD_BYTES)
            doc = owners(offs, starts)
            out["n_words"][i:j] = np.bincount(doc, minlength=j - i).tolist()
            if not len(starts):
                continue
            number = index.numbers(hash_spans(low, starts, ends))
            good = index.pairs[number[:-1], number[1:]] & (doc[:-1] == doc[1:])
            edge = np.diff(np.concatenate(([0], good.view(np.int8), [0])))
            first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i))))
            places: dict[int, list] = {}
            matches: dict[int, dict[int, list]] = {}
            beside = np.concatenate((good, [False])) | np.concatenate(([False], good))
            lone = np.flatnonzero(index.single[number] & ~beside)
            for a, z in zip(np.concatenate((np.flatnonzero(edge == 1), lone)), np.concatenate((np.flatnonzero(edge == -1), lone)), strict=True):
                d = int(doc[a])
                base = int(a - first[d])
                own: dict[int, list] = {}
                for s, _, k in chain(index, index.automaton.statistics(number[a : z + 1].tolist()), least, gap, own):
                    places.setdefault(d, []).append((base + s, k))
                for t, found in own.items():
                    matches.setdefault(d, {}).setdefault(t, []).extend((base + s, base + e, p) for s, e, p in found)
            for d in places.keys() | matches.keys():
                at = i + d
                p = places.get(d, [])
                labels = {names[k] for _, k in p}
                out["base_labels"][at] = ",".join(sorted(labels))
                if p:
                    out["n_base"][at], out["first_word"][at], out["last_word"][at] = len(p), min(p)[0], max(p)[0]
                for t, found in matches.get(d, {}).items():
                    best, spans = template_covers(found, len(index.lists[t]), gap, cover)
                    out["score"][at] = max(out["score"][at], best)
                    for c, s, e in spans:
                        labels.add(index.templates[t][0])
                        out["spans"][at].append({"label": index.templates[t][0], "start": s, "end": e, "cover": c})
                out["spans"][at].sort(key=lambda x: (x["start"], x["end"], x["label"]))
                out["labels"][at] = ",".join(sorted(labels))
        yield {"doc_id": b.column(0)} | out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, cover: double>>"
    return map_batches(df, schema, batch, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
