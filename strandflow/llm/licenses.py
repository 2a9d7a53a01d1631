"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates.

A text is reduced to words in lower case (comment markers and punctuation fall away), and every window of its words is
held against every template, wherever it begins and over any number of lines. A Dice coefficient of at least t needs sizes
within a factor (2 - t) / t and a least number of shared bigrams, so an index from bigrams to templates tells where in the
text a template can be at all; only windows that begin and end with a shared bigram are scored, as any other one scores
less than the window inside it. Of overlapping windows the one that shares most beyond what t asks stands, and what is left
beside it is searched again. A map-only job: the templates are a fixed list, and no text meets another.

Templates are notices, headers of files, and the whole texts of short licences. Of the long licences (Apache, GPL, MPL)
the notice that their whole texts hold at the end is found.

Defined results: null or empty texts have no matches; equal rows give equal rows; of templates that score equally, the
first listed counts; an empty table gives an empty table; only id and text are used, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm.common import bounded_batches

LEAST_DICE = 0.8

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(work: str, kind: str, version: str) -> tuple[str, str]:
    """First paragraph and whole of a GNU header."""
    name = f"GNU {kind}General Public License"
    grant = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f" This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    return grant, grant + rest


_GNU = [("GPL-3.0", "program", "", "3"), ("GPL-2.0", "program", "", "2"), ("LGPL-3.0", "library", "Lesser ", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("AGPL-3.0", "program", "Affero ", "3")]

#: Licence templates, as (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    *((name, text) for name, *form in _GNU for text in _gnu(*form)),
)

_WORD = re.compile(r"[^\W_]+")
#: Comment markers that are words.
_MARKER = re.compile(r"^[ \t]*(?:rem|dnl)\b", re.M)


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


class Templates:
    def __init__(self, templates=TEMPLATES, least: float = LEAST_DICE):
        self.names = [name for name, _ in templates]
        self.least = least
        grams = [bigrams(t) for _, t in templates]
        self.sizes = [g.total() for g in grams]
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, g in enumerate(grams):
            for gram, n in g.items():
                self.index.setdefault(gram, []).append((i, n))
        self.grams = grams
        self.ratio = (2 - least) / least + 1e-9
        #: Shared bigrams that the shortest window within the bounds needs.
        self.needs = [math.ceil(least * (n / self.ratio + n) / 2 - 1e-6) for n in self.sizes]
        self.bounds = min(self.sizes) / self.ratio, max(self.sizes) * self.ratio
        #: Each bigram has a gap and a word of at least one character, after the first word.
        self.least_chars = 2 * self.bounds[0] + 1

    def best(self, segment: str) -> tuple[float, int] | None:
        """(Dice coefficient, template) of the best template that scores enough."""
        if len(segment) < self.least_chars:
            return None
        words = _WORD.findall(segment.lower())
        size = len(words) - 1
        if not self.bounds[0] <= size <= self.bounds[1]:
            return None
        shared: Counter = Counter()
        for gram, n in Counter(zip(words, words[1:], strict=False)).items():
            for i, m in self.index.get(gram, ()):
                if size <= self.sizes[i] * self.ratio and self.sizes[i] <= size * self.ratio:
                    shared[i] += min(n, m)
        found = max(((2 * s / (size + self.sizes[i]), -i) for i, s in shared.items()), default=(0, 0))
        return (found[0], -found[1]) if found[0] >= self.least else None


def _windows(words: list[str], lo: int, hi: int, hits: dict[int, list[int]], templates: Templates) -> list[tuple[float, float, int, int, int]]:
    """(-excess, -Dice, template, first bigram, last bigram): the best window of each template from each place in words[lo:hi]."""
    out, least = [], templates.least
    for i, places in hits.items():
        places = places[bisect_left(places, lo) : bisect_left(places, hi - 1)]
        m, need, grams = templates.sizes[i], templates.needs[i], templates.grams[i]
        most, fewest = int(m * templates.ratio), m / templates.ratio
        for at in range(len(places) - need + 1):
            start = places[at]
            if places[at + need - 1] - start >= most:
                continue
            seen: dict[tuple[str, str], int] = {}
            shared, best = 0, None
            for j in range(at, len(places)):
                k = places[j]
                size = k - start + 1
                if size > most:
                    break
                gram = words[k], words[k + 1]
                n = seen[gram] = seen.get(gram, 0) + 1
                shared += n <= grams[gram]
                if size >= fewest and 2 * shared / (size + m) >= least:
                    found = (least * (size + m) - 2 * shared, -2 * shared / (size + m), i, start, k)
                    best = min(best or found, found)
            if best:
                out.append(best)
    return sorted(out)


def matches(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, coefficient, first line, lines) of every window of words that matches a template; lines count from 0."""
    text = text.lower()
    if "rem" in text or "dnl" in text:
        text = _MARKER.sub(lambda m: " " * len(m[0]), text)
    words, index = _WORD.findall(text), templates.index
    hits: dict[int, list[int]] = {}
    for k, gram in enumerate(zip(words, words[1:], strict=False)):
        if gram in index:
            for i, _ in index[gram]:
                hits.setdefault(i, []).append(k)
    hits = {i: places for i, places in hits.items() if len(places) >= templates.needs[i]}
    if hits:
        seen = Counter((words[k], words[k + 1]) for k in set().union(*hits.values()))
        hits = {i: places for i, places in hits.items() if (seen & templates.grams[i]).total() >= templates.needs[i]}
    taken: list[tuple[int, int, int, float]] = []
    gaps = [(0, len(words))] if hits else []
    while gaps:
        lo, hi = gaps.pop()
        some: list[tuple[int, int, int, float]] = []
        held = bytearray(hi - lo)
        for _, dice, i, first, last in _windows(words, lo, hi, hits, templates):
            if not any(held[first - lo : last + 2 - lo]):
                held[first - lo : last + 2 - lo] = b"\1" * (last + 2 - first)
                some.append((first, last + 1, i, -dice))
        some.sort()
        if some:
            gaps += [(a, b) for a, b in zip([lo, *[x[1] + 1 for x in some]], [*[x[0] for x in some], hi], strict=True) if b - a > 1]
            taken += some
    if not taken:
        return []
    at = [m.start() for m in _WORD.finditer(text)]
    line = lambda k: text.count("\n", 0, at[k])
    return [(templates.names[i], dice, line(first), line(last) - line(first) + 1) for first, last, i, dice in sorted(taken)]


def scan(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, license, dice, line, n_lines)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(least=least)
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(t, templates)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "dice", "line", "n_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, line long, n_lines long")
