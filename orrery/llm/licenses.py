"""License scan: Dice coefficient of word bigrams against templates (operator 4).

A text's normalised words are compared with each template over every window of
the template's own length, so that a notice is found anywhere in a text, a whole
license as well as one line. Size bounds prune first: a text that is too short
for a template, or that holds too few of its bigrams in all, can't reach the
threshold in any window, and that template isn't tried. Of all windows that
reach it the best are taken first, and those that overlap one taken are left out.

Short texts, standard headers and notices are built in. Long licenses are read
as templates from a folder that the user names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import map_batches

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.8

#: License id -> the names by which notices call it.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    **{
        f"CC-{kind}-4.0": [f"CC {kind} 4.0", f"Creative Commons {name} 4.0 International License"]
        for kind, name in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
#: License id -> phrases, each as alternatives, that its header or text must hold, and those that it must not.
_ONLY = {"lesser general", "library general", "affero general"}
TELLING = {
    "GPL-2.0": ([["version 2 of the license", "version 2 as published", "license version 2"]], _ONLY),
    "GPL-3.0": ([["version 3 of the license", "version 3 as published", "license version 3"]], _ONLY),
    "LGPL-2.1": ([["lesser"], ["version 2 1"]], {"affero general"}),
    "LGPL-3.0": ([["lesser"], ["version 3 of the license", "version 3 as published", "license version 3"]], {"affero general"}),
    "AGPL-3.0": ([["affero"], ["version 3 of the license", "version 3 as published", "license version 3"]], {"lesser general", "library general"}),
    "BSD-2-Clause": ([], {"neither", "endorse", "advertising"}),
    "BSD-3-Clause": ([["neither the name", "names of its contributors", "name of the author may not"], ["endorse or promote"]], set()),
    "MPL-2.0": ([["mozilla"], ["2 0"]], set()),
    "CC0-1.0": ([["cc0"]], set()),
}
#: Words after a window that may still tell, as the third clause of BSD-3-Clause does after the second.
AFTER = 12

NOTICES = ["licensed under {}", "licensed under the {}", "released under the {}", "this work is licensed under the {}", "distributed under the terms of the {}"]

#: The header of the GNU licenses, which differs in name and version alone.
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the
Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

#: Texts of short public licenses and standard headers, without their names and copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    **{i: GNU.format(f"GNU {kind} General Public License".replace("  ", " "), n) for i, kind, n in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"),
    )},
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty. You should have received a
copy of the CC0 Public Domain Dedication along with this software. If not, see
http://creativecommons.org/publicdomain/zero/1.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions.""",
}


#: What ends the BSD licenses.
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
#: Whole texts whose beginnings are templates too, as a notice may end there.
WHOLE = [(i, f"{TEXTS[i]} {BSD_END}") for i in ("BSD-2-Clause", "BSD-3-Clause")] + [
    ("Zlib", TEXTS["Zlib"] + """ 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution."""),
]


def templates() -> list[tuple[str, str]]:
    """(license id, text) of notices by rule and of short licenses, in a fixed order."""
    return [(i, n.format(name)) for i, names in NAMES.items() for name in names for n in NOTICES] + list(TEXTS.items()) + WHOLE


def templates_in(spark: SparkSession, folder: str, ids: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(license id, text) of the files of a folder, one license each, in order of id.

    A file's name without ``.txt`` is its id, unless ``ids`` gives another; with
    ``ids`` only the files it names are read.
    """
    files = spark.read.text(f"{folder.rstrip('/')}/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    if ids is not None:
        files = files.where(F.col("name").isin(*ids))
    return sorted(((ids or {}).get(r[0], r[0]), r[1]) for r in files.collect())


#: Templates of fewer words are one-line notices, told by their own versions and kinds; those of more are told by their Dice alone.
LINE, LONG = 25, 400
KINDS = {"lesser", "affero", "cc0", "zero", "by", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"}


def told(license_id: str, own: list[str], words: list[str], start: int, end: int) -> bool:
    """Whether the words of a window tell the license of the template ``own`` from those with nearly the same text."""
    if len(own) < LINE:
        return {w for w in own if w in KINDS or w.isdigit()} <= set(words[start:end])
    if license_id not in TELLING or len(own) >= LONG:
        return True
    needed, barred = TELLING[license_id]
    near = words[start : end + (AFTER if license_id == "BSD-2-Clause" else 0)]
    text = f" {' '.join(near)} "
    return not any(f" {x} " in text for x in barred) and all(any(f" {x} " in text for x in some) for some in needed)


class Scanner:
    """Templates as bigrams of numbered words, shortest first."""

    def __init__(self, given: list[tuple[str, str]], threshold: float = THRESHOLD):
        words = sorted(((i, WORD.findall(t.lower())) for i, t in given), key=lambda x: len(x[1]))
        self.ids, self.sizes = [i for i, w in words if len(w) > 1], [len(w) for _, w in words if len(w) > 1]
        words = [(i, w) for i, w in words if len(w) > 1]
        self.words = [w for _, w in words]
        self.known = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        self.base = len(self.known)
        self.threshold = threshold
        grams = [Counter(self.known[a] * self.base + self.known[b] for a, b in zip(w, w[1:])) for _, w in words]
        self.every = np.array(sorted({g for c in grams for g in c}), np.int64)
        self.counts = np.array([[c.get(g, 0) for g in self.every.tolist()] for c in grams], np.int32).reshape(len(grams), len(self.every))
        self.needed = [math.ceil(threshold * (n - 1) - 1e-9) for n in self.sizes]

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license id, Dice, start, end) in characters of the text.

        Windows that don't overlap: the best first, of equal ones that of the
        larger template, then the one further ahead, then the template given first.
        """
        words, spans = _words(text or "")
        if len(words) < 2:
            return []
        get = self.known.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        keys = ids[at] * self.base + ids[at + 1]
        column = np.minimum(np.searchsorted(self.every, keys), len(self.every) - 1)
        there = self.every[column] == keys
        at, column = at[there], column[there]
        if not len(at):
            return []
        used, here = np.unique(column, return_counts=True)
        possible = np.minimum(self.counts[:, used], here).sum(axis=1)
        grams = np.full(len(ids) - 1, -1, np.int64)
        grams[at] = column
        found = []
        for k in np.flatnonzero(possible >= self.needed).tolist():
            if len(words) * (2 - self.threshold) >= self.sizes[k] * self.threshold:
                found += self._windows(k, grams, at, len(words))
        taken: list[tuple[int, int, int, float]] = []
        free = np.ones(len(words), bool)
        for k, dice, start, end in sorted(found, key=lambda x: (-x[1], -self.sizes[x[0]], x[2], x[0])):
            if free[start:end].all() and told(self.ids[k], self.words[k], words, start, end):
                free[start:end] = False
                taken.append((k, start, end, dice))
        if not taken:
            return []
        spans = list(spans())
        return [(self.ids[k], dice, spans[a][0], spans[b - 1][1]) for k, a, b, dice in sorted(taken, key=lambda x: x[1])]

    def _windows(self, k: int, grams: np.ndarray, at: np.ndarray, n: int):
        """All windows of the template's size that reach the threshold and start with one of its bigrams, or end with the text."""
        own, size = self.counts[k], self.sizes[k]
        width = min(size, n) - 1
        of = at[own[grams[at]] > 0]
        ends = np.searchsorted(of, of + width)
        near = np.flatnonzero(2 * (ends - np.arange(len(of))) >= self.threshold * (size - 1 + width) - 1e-9)
        done = -1
        for i in near.tolist():
            start = min(int(of[i]), n - 1 - width)
            if start == done:
                continue
            done = start
            first = np.searchsorted(of, start)
            shared = np.bincount(grams[of[first : ends[i]]], minlength=len(own))
            dice = 2 * int(np.minimum(shared, own).sum()) / (size - 1 + width)
            if dice >= self.threshold - 1e-9:
                yield k, dice, start, start + width + 1


def _words(text: str):
    """The words in lower case, and a function that gives their places in the text itself."""
    lower = text.lower()
    if len(lower) == len(text):
        return WORD.findall(lower), lambda: (m.span() for m in WORD.finditer(lower))
    return [w.lower() for w in WORD.findall(text)], lambda: (m.span() for m in WORD.finditer(text))


_READY: dict = {}


def scan(docs: DataFrame, given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, span_start, span_end): a row for each notice found.

    A null or empty text has none; a text found twice has rows for each place;
    of equal windows that overlap the one of the larger template is taken, then
    the one further ahead; repeated rows are scanned each; an empty table gives
    an empty one; other columns are left out, whatever their names.
    """
    given = templates() if given is None else given
    mark = (tuple(given), threshold)

    def rows(columns):
        if mark not in _READY:
            _READY[mark] = Scanner(given, threshold)
        scanner = _READY[mark]
        for doc, text in zip(*columns):
            for i, dice, start, end in scanner.find(text):
                yield doc, i, dice, start, end

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, license string, dice double, span_start long, span_end long")
