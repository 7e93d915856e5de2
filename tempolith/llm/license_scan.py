"""License notices in documents, by patience alignment with templates.

Text and template are compared as words (runs of letters and digits, ASCII
lower-cased).  Every ``SEED``-word run of a template is a seed; seeds are found
in all texts by rolling hashes over whole texts, vectorised, and hits that lie
close together on nearby diagonals mark a region.  A region is aligned with
its template by *patience*: words that occur once in both are anchors, the
longest increasing subsequence of their places is kept, and the gaps between
anchors are aligned the same way.  Coverage is the share of the template's
words that are matched.  A region with ``LEAST`` coverage is reported; of
regions that overlap, the one with more matched words wins.

Changed or inserted words can break every seed of a notice that keeps that
coverage.  So a region is also marked wherever a window of ``WIDE`` times the
template's length holds enough of its words, each counted no more often than the
template has it: no notice that spans no more than that window is lost.
Templates shorter than a seed are a seed of their own.

Defined results: null or wordless text has no rows; rows repeated outright are
reported each; of templates with as many matched words the one that is covered
better wins, then the smaller name; texts are scanned whole, however long; an
empty table gives an empty result; other columns are ignored, whatever their
names.  The id 2^63 - 1 is reserved for null and reads as null.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches
from . import near_dedup
from .mixing import mix64
from .suffix_dedup import LAST_ID

SEED, LEAST, WIDE = 3, 0.8, 2
STRETCH = 2 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Published license texts, and the notices and short lines by which licenses are commonly given.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the "
    "License, or (at your option) any later version. {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public "
    "License along with {3}. If not, see <https://www.gnu.org/licenses/>."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
TEMPLATES: dict[str, str] = {
    "0bsd-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "agpl-3.0-notice": "This program is free software: " + _GNU.format("Affero ", "3", "This program", "this program"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-line": "Released under the Apache License 2.0",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause-text": _BSD + _AS_IS,
    "bsd-3-clause-line": "Released under the 3-Clause BSD License",
    "bsd-3-clause-text": _BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _AS_IS,
    "bsd-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "bsl-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
        "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "cc-by-4.0": _CC.format("Attribution"),
    "cc-by-line": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0-notice": _CC.format("Attribution-NonCommercial"),
    "cc-by-nc-nd-4.0-notice": _CC.format("Attribution-NonCommercial-NoDerivatives"),
    "cc-by-nc-sa-4.0-notice": _CC.format("Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd-4.0-notice": _CC.format("Attribution-NoDerivatives"),
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-4.0-notice": _CC.format("Attribution-ShareAlike"),
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the "
        "GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: " + _GNU.format("", "3", "This program", "this program"),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "lgpl-3.0-notice": "This program is free software: " + _GNU.format("Lesser ", "3", "This program", "this program"),
    "mit": "Released under the MIT License",
    "mit-line": "Licensed under the MIT license",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
} | {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")}


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two word sequences."""
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
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        if not pairs:
            continue
        # longest increasing subsequence of the second places
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            at = bisect.bisect_left(tops, j)
            if at == len(tops):
                tops.append(j)
                ends.append(k)
            else:
                tops[at], ends[at] = j, k
            back.append(ends[at - 1] if at else -1)
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        last_a, last_b = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def _is_word() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return ok


_WORD_BYTE = _is_word()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of all words of all texts."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    blank = ~_WORD_BYTE[data]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    hashes, start = near_dedup.word_hashes(data, blank)
    return hashes, np.searchsorted(np.cumsum(size), start, side="right")


def seed_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = mix64(out + h[j : j + n] * np.uint64(2 * j + 3))
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n].encode()) for n in self.names]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {min(SEED, len(w)) for w in self.words}:
            rows = []
            for t, w in enumerate(self.words):
                if min(SEED, len(w)) == k:
                    h = seed_hashes(word_hashes([b" ".join(w)])[0], k)
                    rows += [(x, t, i) for i, x in enumerate(h.tolist())]
            rows.sort()
            self.by_length[k] = tuple(np.array(x, dtype) for x, dtype in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))

        self.counts = [Counter(w) for w in self.words]
        self.least = [max(1, math.ceil(LEAST * len(w) - 1e-9)) for w in self.words]
        hashes = [np.unique(word_hashes([b" ".join(w)])[0]) for w in self.words]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        self.member = np.stack([np.isin(self.vocabulary, x) for x in hashes]) if hashes else np.empty((0, 0), bool)

    def windows(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """For each text and template, the words at which a window with enough of its words begins."""
        out: dict[int, dict[int, list[int]]] = {}
        if not len(h) or not len(self.vocabulary):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        word = at[known]
        for t, least in enumerate(self.least):
            p = known[self.member[t][word]]
            begin, end = p[: max(0, len(p) - least + 1)], p[least - 1 :]
            for x in begin[(end - begin < WIDE * len(self.words[t])) & (doc[begin] == doc[end])].tolist():
                d = int(doc[x])
                out.setdefault(d, {}).setdefault(t, []).append(x - int(first[d]))
        return out

    def hits(self, texts: list[bytes]) -> tuple[dict[int, dict[int, list[tuple[int, int]]]], dict[int, dict[int, list[int]]]]:
        """For each text and template, the (word of the text, word of the template) of seeds, and :meth:`windows`."""
        h, doc = word_hashes(texts)
        first = np.searchsorted(doc, np.arange(len(texts)))
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (seeds, template, place) in self.by_length.items():
            s = seed_hashes(h, k)
            lo = np.searchsorted(seeds, s, side="left")
            hit = np.flatnonzero((lo < len(seeds)) & (seeds[np.minimum(lo, len(seeds) - 1)] == s))
            for p in hit.tolist():
                d = int(doc[p])
                if doc[p + k - 1] != d:
                    continue
                at = int(lo[p])
                while at < len(seeds) and seeds[at] == s[p]:
                    out.setdefault(d, {}).setdefault(int(template[at]), []).append((p - int(first[d]), int(place[at])))
                    at += 1
        return out, self.windows(h, doc, first)

    def scan(self, text: bytes, hits: dict[int, list[tuple[int, int]]], windows: dict[int, list[int]]) -> list[tuple]:
        """(name, start, words, matched, template words, coverage) of the notices of one text."""
        words = words_of(text)
        found = []
        for t, places in hits.items():
            template = self.words[t]
            n = len(template)
            # regions: where the template would begin, by hit; near ones are one region
            starts = sorted((p - i, p) for p, i in places)
            group: list[tuple[int, int]] = []
            for x in [*starts, None]:
                if group and (x is None or x[0] - group[-1][0] > n // 2):
                    lo = max(0, min(g[0] for g in group) - n // 4)
                    hi = min(len(words), max(max(g[0] for g in group) + n, max(g[1] for g in group) + SEED) + n // 4)
                    pairs = patience(words[lo:hi], template)
                    if pairs and len(pairs) >= LEAST * n:
                        found.append((self.names[t], lo + pairs[0][0], pairs[-1][0] - pairs[0][0] + 1, len(pairs), n, len(pairs) / n))
                    group = []
                if x is not None:
                    group.append(x)
        for t, begins in windows.items():
            template, counts = self.words[t], self.counts[t]
            n, step = len(template), len(template) // 4
            # what seeds found of this template is not looked for again
            taken = [(r[1], r[1] + r[2]) for r in found if r[0] == self.names[t]]
            after = 0
            for lo in begins:
                if lo < after or any(a <= lo < b for a, b in taken):
                    continue
                hi = min([len(words), lo + WIDE * n + step, *(a for a, _ in taken if a > lo)])
                after = lo + step
                inside = Counter(w for w in words[lo:hi] if w in counts)
                if sum(min(c, counts[w]) for w, c in inside.items()) < self.least[t]:
                    continue
                pairs = patience(words[lo:hi], template)
                if len(pairs) >= self.least[t]:
                    found.append((self.names[t], lo + pairs[0][0], pairs[-1][0] - pairs[0][0] + 1, len(pairs), n, len(pairs) / n))
                    after = lo + pairs[-1][0] + 1
        found.sort(key=lambda r: (-r[3], -r[5], r[0], r[1]))
        out: list[tuple] = []
        for r in found:
            if all(r[1] + r[2] <= o[1] or o[1] + o[2] <= r[1] for o in out):
                out.append(r)
        return sorted(out, key=lambda r: r[1])


FOUND = "doc_id long, license string, start_word long, n_words long, matched long, template_words long, coverage double"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice: doc_id, license, start_word, n_words, matched, template_words, coverage."""
    known = dict(templates or TEMPLATES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Templates(known)
        for pdf in batches:
            rows = []
            ids, texts = pdf["id"].tolist(), pdf["data"].tolist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= STRETCH):
                    size += len(texts[end])
                    end += 1
                hits, windows = t.hits(texts[at:end])
                for d in sorted(hits.keys() | windows.keys()):
                    rows += [(ids[at + d], *r) for r in t.scan(texts[at + d], hits.get(d, {}), windows.get(d, {}))]
                at = end
            yield pd.DataFrame(rows, columns=["doc_id", "license", "start_word", "n_words", "matched", "template_words", "coverage"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    found = map_batches(docs.select(key.alias("id"), text.alias("data")), run, FOUND)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))
