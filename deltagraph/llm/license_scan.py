"""Licence scan with a generalised suffix automaton of licence tokens.

All templates (and the base phrases) form one automaton over their words.  The words of a document stream through it: at
each place the automaton gives the matching statistic, the length of the longest suffix read so far that occurs in some
template.  Long maximal matches of one template that follow each other in both document and template are chained into a covered span; a span
that covers enough of its template gives the template's label.  A base phrase stands wherever its state is met or implied by suffix links.

Words outside every template reset the automaton, so only runs of template words are streamed.  The templates are fixed and
small, whatever the corpus; each text is scanned whole, in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import carrying, documents
from deltagraph.llm.tokens import ALNUM, hash_word, word_lists, words

#: Phrases that give a label wherever they stand.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Whole texts of short licences, and the notices that the longer ones prescribe, with the labels that they give.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
    Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
    the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
    A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
    along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
    A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License
    along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
    A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License
    along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
    THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
    THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
    from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
    THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
    THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
    ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
    product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
    misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
    with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License"""),
]

#: Words of a match that counts, words between chained matches, and the part of a template that a span must cover.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.6


class Automaton:
    """Generalised suffix automaton over lists of token ids."""

    def __init__(self, texts: list[list[int]], phrases: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self._ends = ends
        for i, t in enumerate([*texts, *phrases]):
            last = 0
            for k, c in enumerate(t):
                last = self._extend(last, c)
                if i < len(texts):
                    ends[last].add((i, k + 1))
        by_len = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in by_len:  # what ends in a state also ends in its suffixes
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]
        own: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(phrases):
            v = 0
            for c in p:
                v = self.next[v][c]
            own.setdefault(v, []).append((i, len(p)))
        #: by state: (phrase, words that must have matched) of the phrases that end there
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.len]
        for v in reversed(by_len):
            self.phrases[v] = own.get(v, []) + [(i, 0) for i, _ in self.phrases[self.link[v]]]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nxt)
        self._ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each token."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        for c in tokens:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            yield v, n


class Scanner:
    """Templates and phrases compiled for scanning."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        lists = word_lists(pa.array([t for _, t in templates] + [p for p, _ in phrases], pa.string()), ALNUM)
        vocab = sorted({w for t in lists for w in t})
        number = {w: i for i, w in enumerate(vocab)}
        hashes = np.array([hash_word(w.decode()) for w in vocab], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        tokens = [[number[w] for w in t] for t in lists]
        self.labels, self.sizes = [x for x, _ in templates], [len(t) for t in tokens[: len(templates)]]
        self.phrase_labels, self.phrase_sizes = [x for _, x in phrases], [len(t) for t in tokens[len(templates) :]]
        #: runs of template words below this length can hold neither a phrase nor a match
        self.shortest = min([min_match, *self.phrase_sizes])
        self.machine = Automaton(tokens[: len(templates)], tokens[len(templates) :])
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def places(self, h: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base places (word, phrase) and long maximal matches (first word, end, state) of a stretch of words; ``starts``: first words of documents."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        cut = np.zeros(len(h) + 1, bool)
        cut[starts] = True
        begin = np.flatnonzero(known & (cut[:-1] | ~np.concatenate([[False], known[:-1]])))
        after = cut[1:].copy()
        end = np.flatnonzero(known & (after | ~np.concatenate([known[1:], [False]]))) + 1
        long = end - begin >= self.shortest
        base, matches = [], []
        phrases, sizes, least = self.machine.phrases, self.phrase_sizes, self.min_match
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            before, v0 = 0, 0
            for i, (v, n) in enumerate(self.machine.stream(self.ids[at[a:b]].tolist()), a):
                if phrases[v]:
                    base += [(i + 1 - sizes[p], p) for p, need in phrases[v] if n >= need]
                if n <= before and before >= least:
                    matches.append((i - before, i, v0))
                before, v0 = n, v
            if before >= least:
                matches.append((b - before, b, v0))
        return base, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered part) of chains of a document's matches, in order; of overlapping ones that which covers most."""
        open_: dict[int, list[int]] = {}
        done = []

        def close(t: int) -> None:
            first, end, _, covered = open_.pop(t)
            if covered / self.sizes[t] >= self.min_cover:
                done.append((self.labels[t], first, end, covered / self.sizes[t], covered))

        for a, b, v in matches:
            for t in {t for t, _ in self.machine.ends[v]}:
                ends = [e for x, e in self.machine.ends[v] if x == t]
                if t in open_:
                    first, end, place, covered = open_[t]
                    # the first occurrence in the template that goes beyond what is covered
                    later = next((e for e in ends if e > place), None)
                    if later is not None and a - end <= self.max_gap:
                        new = min(b - a, later - place, b - end)
                        if new > 0:
                            open_[t] = [first, b, later, covered + new]
                        continue
                    close(t)
                open_[t] = [a, b, ends[0], b - a]
        for t in list(open_):
            close(t)
        # licences share passages: where spans overlap, the label that covers the most words stands
        best = [x for x in done if not any(y[0] != x[0] and y[4] > x[4] and y[1] < x[2] and x[1] < y[2] for y in done)]
        return sorted((x[:4] for x in best), key=lambda x: (x[1], x[2], x[0]))


SPANS = "array<struct<label:string,first:long,end:long,cover:double>>"


@carrying
def scan(docs: DataFrame, keep: list[str], scanner: Scanner | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns plus n_words, n_base, first_word, last_word, base_labels, labels (arrays), score and spans.

    score is the largest covered part of a template, 1 where a base phrase stands, 0 without either.  Null and empty texts have no words and no labels."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            for w in words(b.column(text), ALNUM):
                n = w.hi - w.lo
                base, matches = s.places(w.hash, w.first[:-1])
                by_base: dict[int, list] = {}
                by_match: dict[int, list] = {}
                for rows, found in ((by_base, base), (by_match, matches)):
                    docs_of = np.searchsorted(w.first, [x[0] for x in found], "right") - 1 if found else []
                    for i, x in zip(docs_of, found):
                        rows.setdefault(int(i), []).append((x[0] - int(w.first[i]), *x[1:]))
                n_base, first, last, base_labels, labels, score, spans = [], [], [], [], [], [], []
                for i in range(n):
                    p = by_base.get(i, [])
                    mine = [(a, e - int(w.first[i]), v) for a, e, v in by_match.get(i, [])]
                    sp = s.spans(mine) if mine else []
                    own = sorted({s.phrase_labels[x] for _, x in p})
                    n_base.append(len(p))
                    first.append(min(x for x, _ in p) if p else None)
                    last.append(max(x for x, _ in p) if p else None)
                    base_labels.append(own)
                    labels.append(sorted({*own, *(x[0] for x in sp)}))
                    score.append(1.0 if p else max((x[3] for x in sp), default=0.0))
                    spans.append([dict(zip(("label", "first", "end", "cover"), x)) for x in sp])
                cols = [b.column(c).slice(w.lo, n) for c in keep]
                strings = pa.list_(pa.string())
                cols += [pa.array(np.diff(w.first)), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, strings), pa.array(labels, strings), pa.array(score, pa.float64()), pa.array(spans, span_type)]
                yield pa.record_batch(cols, [*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"{kept}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans {SPANS}"
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir), ["doc_id"])
    return out.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ",")).drop("spans")
