"""License scan: parts of a text compared with license templates by Dice coefficient over word bigrams.

The parts of a text are its lines, its paragraphs (runs of lines with a word) of
two lines or more, the whole text, and for each template the word spans closest to
it, wherever they begin and end: the best span of all, then the best ones that do
not overlap those found. A part is normalised to lower-case words
``[a-z0-9]+`` and compared by the multiset of its word bigrams; a part of one
word has that word as its only item. With sizes a and b a Dice coefficient of t
needs a between t/(2-t) * b and (2-t)/t * b, so a part meets only the templates
in those bounds, and of them only those that share a bigram. Templates are a
parameter held by every task; a best span begins and ends with a bigram of its
template, and t/(2-t) * b of its bigrams lie in it, so other places are skipped. Each document is scanned on its own, so nothing is
shuffled; a text costs its task a time in proportion to its length times the longest template that it shares words with,
however often license texts repeat in it. Rows that repeat, or share an id or have none, give a row each; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import schema_of

THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+")

_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_LIABILITY = """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": _GRANT + " " + _AS_IS,
    "BSD-3-Clause": _GRANT + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. """ + _AS_IS,
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:MIT-file": "Licensed under the MIT License. See LICENSE in the project root for license information.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "notice:CC-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice:CC0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}
# whole texts of the short licenses, beside the grants alone
TEMPLATES |= {
    "MIT:full": TEMPLATES["MIT"] + " " + _NO_WARRANTY,
    "ISC:full": TEMPLATES["ISC"] + " " + _AUTHOR,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR,
    "BSD-2-Clause:full": TEMPLATES["BSD-2-Clause"] + " " + _LIABILITY,
    "BSD-3-Clause:full": TEMPLATES["BSD-3-Clause"] + " " + _LIABILITY,
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w,) for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class TemplateIndex:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        self.templates = {k: c for k, t in sorted(templates.items()) if (c := bigrams(words_of(t)))}
        self.sizes = {k: c.total() for k, c in self.templates.items()}
        ratio = threshold / (2 - threshold)
        self.bounds = {k: (ratio * n, n / ratio) for k, n in self.sizes.items()}
        self.least = min((lo for lo, _ in self.bounds.values()), default=0)
        self.most = max((hi for _, hi in self.bounds.values()), default=-1)
        self.holders: dict[tuple, list[str]] = {}
        for k, c in self.templates.items():
            for g in c:
                self.holders.setdefault(g, []).append(k)

    def matches(self, words: list[str]) -> list[tuple[str, float]]:
        """(license, Dice) of the templates at the threshold or above."""
        n = max(len(words) - 1, 1) if words else 0
        if not self.least <= n <= self.most:
            return []
        part = bigrams(words)
        near = {k for g in part.keys() & self.holders.keys() for k in self.holders[g] if self.bounds[k][0] <= n <= self.bounds[k][1]}
        scored = [(k, dice(part, self.templates[k])) for k in sorted(near)]
        return [(k, d) for k, d in scored if d >= self.threshold]

    def spans(self, words: list[str]) -> set[tuple[int, int]]:
        """(first word, end) of the spans at the threshold: per template the best of all spans, then the best beside those found.

        Each place of a shared bigram has its best span computed once. A queue gives the best of all; a place inside a span
        already found is passed over, and one whose span runs into it is computed again up to its edge, which concerns
        only places within a template's length of it. So the work is in proportion to the text, whatever repeats in it.
        """
        at: dict[str, list[int]] = {}
        for i, g in enumerate(zip(words, words[1:])):
            for k in self.holders.get(g, ()):
                at.setdefault(k, []).append(i)
        found = set()
        for k, hits in at.items():
            queue = [(-d, first, last) for first in range(len(hits)) for d, last in self._from(k, words, hits, first, len(words))]
            heapify(queue)
            begins, ends = [], []  # of the spans found for this template, in order
            while queue:
                _, first, last = heappop(queue)
                p = bisect_right(begins, hits[first] + 1)  # spans that begin at or before the place's second word
                if p and ends[p - 1] > hits[first]:
                    continue
                edge = begins[p] if p < len(begins) else len(words)
                if hits[last] + 2 > edge:
                    for d, last in self._from(k, words, hits, first, edge):
                        heappush(queue, (-d, first, last))
                    continue
                span = (hits[first], hits[last] + 2)
                begins.insert(p, span[0])
                ends.insert(p, span[1])
                found.add(span)
        for i, w in enumerate(words if any((w,) in self.holders for w in words) else ()):
            if (w,) in self.holders:
                found.add((i, i + 1))
        return found

    def _from(self, k: str, words: list[str], hits: list[int], first: int, edge: int) -> list[tuple[float, int]]:
        """(Dice, place in ``hits`` of the last bigram) of the best span at the threshold that begins at ``hits[first]`` and ends
        by word ``edge``, the longest on a tie; empty without one."""
        template, size, (least, most) = self.templates[k], self.sizes[k], self.bounds[k]
        need, begin = max(math.ceil(least - 1e-9), 1), hits[first]
        if first + need > len(hits) or hits[first + need - 1] - begin >= most + 1e-9 or hits[first + need - 1] + 2 > edge:
            return []
        best, where, seen, shared = 0.0, None, {}, 0
        for last in range(first, len(hits)):
            at = hits[last]
            n = at - begin + 1
            if n > most + 1e-9 or at + 2 > edge:
                break
            g = (words[at], words[at + 1])
            seen[g] = c = seen.get(g, 0) + 1
            shared += c <= template[g]
            if 2 * shared >= self.threshold * (n + size) - 1e-9:
                d = 2 * shared / (n + size)
                if d >= self.threshold and d >= best:
                    best, where = d, last
        return [] if where is None else [(best, where)]


@cache
def default_index() -> TemplateIndex:
    return TemplateIndex(TEMPLATES, THRESHOLD)


def parts_of(text: str, index: TemplateIndex | None = None):
    """(first line, lines, words) of every line, paragraph, the whole text and the index's other spans."""
    lines = [words_of(x) for x in text.split("\n")]
    ends = list(accumulate(map(len, lines)))
    words, whole = [x for y in lines for x in y], set()
    for i, w in enumerate(lines):
        whole.add((ends[i] - len(w), ends[i]))
        yield i, 1, w
    start = 0
    for i, w in enumerate([*lines, []]):
        if not w:
            if i - start > 1 and i - start < len(lines):
                whole.add((ends[start] - len(lines[start]), ends[i - 1]))
                yield start, i - start, [x for y in lines[start:i] for x in y]
            start = i + 1
    if len(lines) > 1:
        whole.add((0, len(words)))
        yield 0, len(lines), words
    for begin, end in sorted((index or default_index()).spans(words) - whole):
        line, last = bisect_right(ends, begin), bisect_right(ends, end - 1)
        yield line, last - line + 1, words[begin:end]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: id, license, dice (the best match, the first name on a tie; null without one), n_matches, matches.

    ``matches`` lists (first_line, n_lines, license, dice) of every part and
    template at the threshold or above. A null or empty text matches nothing.
    """
    kind = "array<struct<first_line:int,n_lines:int,license:string,dice:double>>"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = schema_of(slim.select("id", F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_matches"),
                                   F.expr(f"cast(null as {kind})").alias("matches")))
    arrow = pa.list_(pa.struct([("first_line", pa.int32()), ("n_lines", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches):
        index = TemplateIndex(templates, threshold)
        for b in batches:
            found = [[(i, n, k, d) for i, n, w in parts_of(t.as_py() or "", index) for k, d in index.matches(w)] for t in b.column("text")]
            best = [min(((-d, k) for _, _, k, d in f), default=(None, None)) for f in found]
            named = [[dict(zip(("first_line", "n_lines", "license", "dice"), m)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([k for _, k in best], pa.string()), pa.array([None if d is None else -d for d, _ in best], pa.float64()),
                 pa.array([len(f) for f in found], pa.int64()), pa.array(named, arrow)], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
