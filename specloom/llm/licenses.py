"""Operator 10, licence scans: matching statistics from a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A file's tokens stream through it; at each token it knows
the longest run ending there that some template has, and where that run ends in which templates. Long matches of a
template that follow each other in file and template are chained into spans, kept where they cover enough of it.
"""

from __future__ import annotations

import bisect
import pkgutil
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm.common import pick, ready
from specloom.llm.kernel import Lookup, as_string, chunks, words
from specloom.session import table

#: Tokens of a match that counts as long; of a template of fewer, all.
MIN_MATCH = 4
#: Tokens between chained matches, in the file and in the template, at most.
MAX_GAP = 12
#: Share of the template that a span must cover, or else the tokens that it must cover.
MIN_SHARE, MIN_TOKENS = 0.8, 40

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)


def _gnu(name: str, versions: str) -> str:
    """The notice of a GNU licence for the files of a program."""
    what = "library" if "Lesser" in name else "program"
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either {versions} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be "
        f"useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} "
        "for more details."
    )


def _whole(name: str) -> str:
    """The licence's own text, as its steward publishes it."""
    return pkgutil.get_data("specloom.llm", f"license_texts/{name}.txt").decode()


#: Public licence notices by licence; every text is a template of its own.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        _whole("Apache-2.0"),
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _WARRANTY,
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        _whole("GPL-3.0"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("GNU General Public License", "version 2"),
        _whole("GPL-2.0"),
    ),
    "LGPL-2.1": (_gnu("GNU Lesser General Public License", "version 2.1"), _whole("LGPL-2.1")),
    "LGPL-3.0": (_gnu("GNU Lesser General Public License", "version 3"), _whole("LGPL-3.0")),
    "AGPL-3.0": (_gnu("GNU Affero General Public License", "version 3"),),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        _whole("MPL-2.0"),
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-2-Clause": (_BSD + _BSD_WARRANTY,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _BSD_WARRANTY,),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-Rights-Reserved": ("All rights reserved.",),
}


def templates_of(rows: DataFrame) -> dict[str, tuple[str, ...]]:
    """Templates from a table of ``license`` and ``text``, those of a licence in order; NULL and wordless rows are left out.

    The templates are held by every worker, as the automaton of them is.
    """
    out: dict[str, list[str]] = {}
    for r in rows.select("license", "text").where("license is not null and text is not null").distinct().orderBy("license", "text").collect():
        if len(words(pa.array([r.text])).hash):
            out.setdefault(r.license, []).append(r.text)
    return {k: tuple(v) for k, v in out.items()}


class Span(NamedTuple):
    """Tokens ``start`` to ``end`` of a file that cover ``covered`` tokens of a template."""

    license: str
    template: int
    start: int
    end: int
    covered: int
    size: int


class Automaton:
    """Generalised suffix automaton of integer token sequences.

    Each state keeps, for every template, all ends of its runs, gathered along suffix links after construction.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].add((t, i))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, link: int, step: dict[int, int], ends: list[set]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set]) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[set]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        state, p = self._new(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return state

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For every token, the state and the length of the longest run ending there that a template has."""
        state = held = 0
        step, link, length = self.next, self.link, self.length
        for c in tokens:
            while state and c not in step[state]:
                state = link[state]
                held = length[state]
            if c in step[state]:
                state = step[state][c]
                held += 1
            else:
                held = 0
            yield state, held


class Scanner:
    """Finds template spans in texts."""

    def __init__(self, templates: dict[str, tuple[str, ...]], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> None:
        self.names = [(name, k) for name, texts in sorted(templates.items()) for k in range(len(texts))]
        hashed = [words(pa.array([templates[name][k]])).hash for name, k in self.names]
        self.size = [len(h) for h in hashed]
        self.lookup = Lookup(np.concatenate(hashed), 16)
        self.sequences = [np.searchsorted(self.lookup.keys, h).tolist() for h in hashed]
        self.automaton = Automaton(self.sequences)
        self.min_match, self.max_gap = min_match, max_gap
        self.least = [min(min_match, n) for n in self.size]
        self.shortest = min(self.least)
        # a match is no longer than its state, so that others' ends are never asked for
        self.automaton.ends = [[(t, e) for t, e in ends if n >= self.least[t]] for n, ends in zip(self.automaton.length, self.automaton.ends)]
        #: by state, templates that are a shorter end of its runs as a whole
        self.inner: list[list[int]] = []
        for state, ends in enumerate(self.automaton.ends):
            own, whole, p = set(ends), set(), self.automaton.link[state]
            while p > 0:
                whole |= {t for t, e in self.automaton.ends[p] if e + 1 == self.size[t] <= self.automaton.length[p] and (t, e) not in own}
                p = self.automaton.link[p]
            self.inner.append(sorted(whole))

    def matches(self, tokens: list[int], base: int = 0) -> list[tuple[int, int, int, int]]:
        """Long matches that can't be made longer to the right, and whole templates inside of them: template, its first
        token, the file's first, length."""
        at = list(self.automaton.statistics(tokens))
        out = []
        for i, (state, held) in enumerate(at):
            if held < self.shortest:
                continue
            ends = [(t, e) for t, e in self.automaton.ends[state] if held >= self.least[t]]
            if i + 1 < len(at) and at[i + 1][1] == held + 1:
                # templates that the longer match leaves behind end here
                stay = {(t, e - 1) for t, e in self.automaton.ends[at[i + 1][0]]}
                ends = [x for x in ends if x not in stay]
            out += [(t, e - held + 1, base + i - held + 1, held) for t, e in ends]
            out += [(t, 0, base + i - self.size[t] + 1, self.size[t]) for t in self.inner[state]]
        return out

    def chain(self, found: list[tuple[int, int, int, int]]) -> list[Span]:
        """Spans of matches of one template that follow each other within the gap, by most tokens covered."""
        out: list[Span] = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, at, pos, n in found:
            by.setdefault(t, []).append((pos, at, n))
        for t, ms in by.items():
            ms.sort()
            best: list[tuple[int, int]] = []  # tokens covered, span start
            longest = max(n for _, _, n in ms)
            first = 0
            for i, (pos, at, n) in enumerate(ms):
                top = (n, -pos)
                while ms[first][0] < pos - self.max_gap - longest:
                    first += 1
                for j in range(i - 1, first - 1, -1):
                    p2, a2, n2 = ms[j]
                    if a2 >= at or p2 + n2 + self.max_gap < pos or a2 + n2 + self.max_gap < at:
                        continue
                    lost = max(0, p2 + n2 - pos, a2 + n2 - at)
                    if lost < n and p2 < pos:
                        top = max(top, (best[j][0] + n - lost, best[j][1]))
                best.append(top)
            spans = sorted(((-c, -s, pos + n) for (c, s), (pos, at, n) in zip(best, ms)))
            taken: list[tuple[int, int]] = []
            for minus, start, end in spans:
                k = bisect.bisect(taken, (start, end))
                free = (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0])
                if free and (-minus >= MIN_SHARE * self.size[t] or -minus >= MIN_TOKENS):
                    taken.insert(k, (start, end))
                    out.append(Span(*self.names[t], start, end, -minus, self.size[t]))
        return self.best(sorted(out, key=lambda s: (s.start, s.end, s.license, s.template)))

    def best(self, spans: list[Span]) -> list[Span]:
        """Without spans inside one of another template that covers more, or as much of a shorter one, unless they are a whole template word for word."""
        longest, out = max((s.end - s.start for s in spans), default=0), []
        starts = [s.start for s in spans]
        for s in spans:
            near = spans[bisect.bisect_left(starts, s.end - longest) : bisect.bisect_right(starts, s.start)]
            if s.covered == s.size == s.end - s.start or not any(o.end >= s.end and (-o.covered, o.size) < (-s.covered, s.size) for o in near):
                out.append(s)
        return out

    def scan(self, arr: pa.Array) -> list[list[Span]]:
        """Spans of every text. Only runs of at least ``shortest`` template tokens can hold a long match, so the
        automaton, which any other token resets, is run over these."""
        out: list[list[Span]] = [[] for _ in range(len(arr))]
        for first, part in chunks(as_string(arr)):
            w = words(part)
            at, code = self.lookup(w.hash)
            if not len(at):
                continue
            row = w.row[at]
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(at)]
            found: dict[int, list] = {}
            for a, b in zip(lo[hi - lo >= self.shortest].tolist(), hi[hi - lo >= self.shortest].tolist()):
                if ms := self.matches(code[a:b].tolist(), int(at[a] - w.bounds[row[a]])):
                    found.setdefault(int(row[a]), []).extend(ms)
            for r, ms in found.items():
                out[first + r] = self.chain(ms)
        return out


KIND = "array<struct<license string, template int, start_token bigint, end_token bigint, covered bigint, size bigint>>"


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Template spans of every document: licence, number of its template, token range, tokens covered of the template's.

    NULL and empty texts have none; rows with NULL ids and repeated rows are scanned like all others. Spans of one
    template don't overlap, those of different templates may, but for parts of templates inside a span that covers more;
    equal chains fall to the earlier start. An empty table gives no spans.
    """
    ready(docs)
    scanner = Scanner(TEMPLATES if templates is None else templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("covered", pa.int64()), ("size", pa.int64())]))

    @arrow_udf(KIND)
    def scan(a: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("license", "template", "start_token", "end_token", "covered", "size"), s)) for s in spans] for spans in scanner.scan(a)], kind)

    d = pick(docs, "doc_id", "text")
    return d.select("doc_id", F.explode(scan("text")).alias("s")).select("doc_id", "s.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence spans of all documents."""
    return license_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
