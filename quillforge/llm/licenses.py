"""License scans by patience alignment.

A text's words near a template's seed words are aligned with the template: words that occur once in
both are anchors, the longest increasing subsequence of their places is kept, and the gaps between
kept anchors are aligned in the same way; equal words next to a gap's ends are taken first, and a gap
without anchors goes by its longest common subsequence. The share of the template's words that are
matched, in order, is its coverage. From COVERAGE on it is reported with the code points from the
first matched word to the last, if its marks, the words that tell it from its like, are all among the
matched and marks that are neighbours in the template are neighbours in the text (so no Lesser license
passes for the General one). Of overlapping reports the one with more matched words stays (then more coverage, then
the earlier name).

A template's seeds are its rarest mark, or, where it has none, more words than a report may miss; so
every report holds a seed at its place. TEMPLATES holds notices, headers and short whole texts;
`templates` takes others, such as the whole texts of long licenses, in their place.

Words are runs of letters, digits and inner points or dashes, lower-cased. Cases: null and empty
texts have no licenses; any number of notices in a text is found, each on its own; a very long text
is scanned whole, with work only where seeds stand; equal texts give equal reports and repeated rows
are rows each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm.common import slices, strings, table

COVERAGE = 0.8

WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def gnu_header(what: str, version: str, name: str) -> str:
    """The header that the GNU licenses ask for."""
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or "
        f"(at your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


#: SPDX names that stand in files as an identifier line.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "Unlicense", "CC0-1.0", "BSL-1.0", "EPL-2.0")
#: Wordings of public licenses and their notices: name (SPDX where there is one), text, marks.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT-notice", "Released under the MIT License.", "mit"),
    ("MIT-notice", "This project is licensed under the MIT License", "mit"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "",
    ),
    ("MIT-disclaimer", f"{AS_IS} {WARRANTY}", "noninfringement"),
    ("Apache-notice", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    ("GPL-notice", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("LGPL-notice", "Licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("LGPL-2.1-notice", "Licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser general public 2.1"),
    ("AGPL-notice", "Licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("GPL-3.0-or-later", gnu_header("This program", "3", "General Public License"), "gnu 3"),
    ("GPL-2.0-or-later", gnu_header("This program", "2", "General Public License"), "gnu 2"),
    ("LGPL-3.0-or-later", gnu_header("This library", "3", "Lesser General Public License"), "gnu lesser 3"),
    ("LGPL-2.1-or-later", gnu_header("This library", "2.1", "Lesser General Public License"), "gnu lesser 2.1"),
    ("AGPL-3.0-or-later", gnu_header("This program", "3", "Affero General Public License"), "gnu affero 3"),
    ("CC-BY-NC-notice", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-SA-notice", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-notice", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4.0"),
    ("CC-BY-SA-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons attribution-sharealike 4.0"),
    ("CC-BY-NC-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons attribution-noncommercial 4.0"),
    ("CC0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived neighboring"),
    ("BSD-notice", "This project is licensed under the BSD License", "bsd"),
    ("BSD-2-Clause", BSD_CLAUSES + BSD_END, "redistribution redistributions"),
    ("BSD-3-Clause", BSD_CLAUSES + BSD_THIRD + BSD_END, "redistribution redistributions endorse"),
    ("BSD-conditions", BSD_CLAUSES, "redistribution redistributions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "as-is",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"),
    ("BSL-1.0-notice", "Distributed under the Boost Software License, Version 1.0.", "boost 1.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "eclipse 2.0"),
    *((name, f"SPDX-License-Identifier: {name}", f"spdx-license-identifier {name.lower()}") for name in SPDX),
)
#: Seeds that a template takes last, as any text holds them.
COMMON = frozenset("a above all an and any are as at by can copy distribute distributed following for form from hereby in including is it may modify not notice obtain of on one or person purpose source subject terms that the this to under use was will with work you".split())
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m[0].lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second rises (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back[k] = piles[p - 1] if p else -1
        tops[p : p + 1] = [y]
        piles[p : p + 1] = [k]
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _common(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a[a0:a1] and b[b0:b1]."""
    held = set(b[b0:b1])
    rows = [k for k in range(a0, a1) if a[k] in held]
    best = [[0] * (b1 - b0 + 1) for _ in range(len(rows) + 1)]
    for i in range(len(rows) - 1, -1, -1):
        for j in range(b1 - b0 - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[rows[i]] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(rows) and j < b1 - b0:
        if a[rows[i]] == b[b0 + j]:
            out.append((rows[i], b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            out += _common(a, b, a0, a1, b0, b1)
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


class _Template:
    def __init__(self, name: str, text: str, marks: str, coverage: float):
        self.name, self.words = name, words(text)[0]
        self.slack = max(3, len(self.words) // 4)
        self.count = Counter(self.words)
        n = len(self.words)
        self.need = next(k for k in range(n + 1) if k == n or k / n >= coverage)
        self.marks = frozenset(marks.split())
        rarest = lambda k: (self.words[k] in COMMON, self.count[self.words[k]], -len(self.words[k]), k)
        if self.marks:
            best = self.words[min((k for k in range(n) if self.words[k] in self.marks), key=rarest)]
            self.seeds = [(k, w) for k, w in enumerate(self.words) if w == best]
        else:
            self.seeds = [(k, self.words[k]) for k in sorted(range(n), key=rarest)[: n - self.need + 1]]

    def match(self, own: list[str], at: int) -> list[tuple[int, int]] | None:
        """Matched places if the template stands in the words `own` from about `at`."""
        n = len(self.words)
        low, exact = max(0, at - self.slack), max(0, at)
        near = own[low : at + n + self.slack]
        if (Counter(near) & self.count).total() < self.need or not self.marks <= set(near):
            return None
        # the span at the seed's own offset, or the wider one if that matches more
        pairs = max([(k + exact, j) for k, j in align(own[exact : at + n], self.words)], [(k + low, j) for k, j in align(near, self.words)], key=len)
        fits = len(pairs) >= self.need and self.marks <= {self.words[j] for _, j in pairs}
        # marks that stand side by side in the template name one thing, which no other word may change
        fits = fits and all(k + 1 == m or j + 1 != i or not {self.words[j], self.words[i]} <= self.marks for (k, j), (m, i) in zip(pairs, pairs[1:], strict=False))
        return pairs if fits else None


Templates = tuple[tuple[str, str, str], ...]


@functools.cache
def _templates(coverage: float, templates: Templates = TEMPLATES) -> tuple[list[_Template], frozenset[str], str]:
    """The templates, all their seeds, and a pattern that every text with a seed matches."""
    made = [_Template(*t, coverage) for t in templates]
    seeds = frozenset(w for t in made for _, w in t.seeds)
    return made, seeds, "(?i)" + "|".join(map(re.escape, sorted(seeds)))


def _apart(found: list[tuple]) -> list[tuple[int, int, str, float]]:
    """The best of overlapping reports (-matched, -coverage, name, start, end), by start."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for _, share, name, a, b in sorted(found):
        k = bisect_left(starts, b)  # those that start before the end; only the last can reach here
        if k == 0 or kept[k - 1][1] <= a:
            starts.insert(k, a)
            kept.insert(k, (a, b, name, -share))
    return kept


def find_licenses(text: str, coverage: float = COVERAGE, templates: Templates = TEMPLATES) -> list[tuple[int, int, str, float]]:
    """(start, end, name, coverage) of each notice, by start."""
    own, spans = words(text)
    made, seeds, _ = _templates(coverage, templates)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(own):
        if w in seeds:
            places.setdefault(w, []).append(k)
    found = []
    for t in made:
        for at in {p - k for k, w in t.seeds for p in places.get(w, ())}:
            if (pairs := t.match(own, at)) is not None:
                found.append((-len(pairs), -len(pairs) / len(t.words), t.name, spans[pairs[0][0]][0], spans[pairs[-1][0]][1]))
    return _apart(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates = TEMPLATES) -> DataFrame:
    """(id, licenses) of every row; licenses are an array of (name, start, end, coverage)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = strings(batch.column(1))
            hits = pc.match_substring_regex(texts, _templates(COVERAGE, templates)[2]).to_pylist()
            found = [[{"name": n, "start": a, "end": b, "coverage": c} for a, b, n, c in find_licenses(t.as_py(), COVERAGE, templates)] if hit else [] for t, hit in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=["id", "licenses"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, licenses array<struct<name:string,start:long,end:long,coverage:double>>")
    return out.withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, as name:start:end by start."""
    found = scan(table(spark, sf_dir, "documents"))
    text = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", text).alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))
