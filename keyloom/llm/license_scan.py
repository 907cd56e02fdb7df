"""Licence notices in documents, by conditional compression.

A block of text that says a licence's words compresses much better with that licence as dictionary.  A notice that differs from a template in at most
MAX_DIFFERENCE of its words has a run of template words of some length in it, so that a candidate block lies around each such run, as wide as the template and the difference
allow; its words (in lower case, a blank between, so that layout doesn't matter) are compressed by zstandard alone and with every template's words as raw dictionary, templates are ranked by the reduction,
and those that have a run there and reduce enough are confirmed by an exact comparison of words: at most MAX_DIFFERENCE of the template's words may be
missing or extra in the part of the block that it covers.  What differs is reported.

Plan: one Arrow pass, no shuffle.  A linear-time scan of each batch picks texts with any cue, a word of every run that a template can be found by; cues are
chosen from the templates given, rare words first.  Templates of any length and number are a parameter, and go to the workers with the function (a few kilobytes).

Defined results: null and empty texts hold no licence; lines, blank lines and comment marks mean nothing, only words count; of
templates found at one place the one with most words matched, less those missing and extra, counts, then the larger reduction, then the name, and each place is reported once; templates without words are never found; repeated rows report each; a null doc_id is reported as null; offsets count code points; other columns are not read.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Disjoint, text_slices

MIN_GAIN = 0.2
MAX_DIFFERENCE = 0.15
KNOWN_BLOCKS = 4096
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_MIT_END = """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_NAMES = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""
#: (licence, wording): a licence may have several wordings.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_END),
    ("Zlib", _ZLIB),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
)
_RARE = re.compile(r"licen[sc]|copyright|copyleft|permission|redistribut|warrant|merchantab|unencumbered|commons|lesser|public|attribution|hereby|herein|thereof")
_WORDS = re.compile(r"\w+")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORDS.finditer(text)]


class Compressors:
    """A compressor without a dictionary and one for each template, and how to find where a template may stand."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.templates = templates
        self.words = [[w for w, _, _ in _words(t)] for _, t in templates]
        self.limits = [int(MAX_DIFFERENCE * len(w)) for w in self.words]
        #: runs[n]: the templates, and the places in them, of each run of n words; n is the longest run that each notice must have
        self.runs: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        self.cues: set[str] = set()
        for i, (words, limit) in enumerate(zip(self.words, self.limits)):
            if words:
                n = max(1, -(-(len(words) - limit) // (limit + 1)))
                for a in range(len(words) - n + 1):
                    run = words[a : a + n]
                    self.runs.setdefault(n, {}).setdefault(tuple(run), []).append((i, a))
                    if self.cues.isdisjoint(run):
                        self.cues.add(max(run, key=lambda w: (_RARE.search(w) is not None, len(w), w)))
        self.known: dict[str, tuple[int, list[tuple[int, int]]]] = {}

        def make(**more: object) -> zstandard.ZstdCompressor:
            settings = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0)
            return zstandard.ZstdCompressor(compression_params=settings, **more)

        self.alone = make()
        self.given = [make(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if w else None for w in self.words]

    def cue_pattern(self) -> str:
        """For RE2, a superset of the texts with a cue among their words; the kelvin sign's lower case is a plain k."""
        words = [rf"\b{w}\b" if w.isascii() else re.escape(w) for w in sorted(self.cues)]
        return "(?i)" + "|".join([*words, r"\x{212a}"]) if words else r"[^\s\S]"

    def ranked(self, block: str) -> tuple[int, list[tuple[int, int]]]:
        """The size of the block's words alone, and (size, template) from the smallest."""
        block = " ".join(w for w, _, _ in _words(block))
        if block not in self.known:
            if len(self.known) >= KNOWN_BLOCKS:
                self.known.clear()
            raw = block.encode("utf-8", "surrogatepass")
            self.known[block] = len(self.alone.compress(raw)), sorted((len(c.compress(raw)), i) for i, c in enumerate(self.given) if c is not None)
        return self.known[block]

    def windows(self, own: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last word + 1) of each part of a text that a template may be found in, by the runs that it shares with it."""
        shifts: dict[int, set[int]] = {}
        cues = [k for k, w in enumerate(own) if w in self.cues]
        for n, runs in self.runs.items():
            done = -1
            for k in cues:
                for p in range(max(done + 1, k - n + 1, 0), min(k, len(own) - n) + 1):
                    done = p
                    for i, a in runs.get(tuple(own[p : p + n]), ()):
                        shifts.setdefault(i, set()).add(p - a)
        for i, found in shifts.items():
            group: list[int] = []
            for d in [*sorted(found), None]:
                # words missing or extra before a run shift it, by no more than the limit
                if group and (d is None or d - group[0] > self.limits[i]):
                    yield i, max(0, group[0] - self.limits[i]), min(len(own), group[-1] + len(self.words[i]) + self.limits[i])
                    group = []
                if d is not None:
                    group.append(d)


def confirmed(template: list[str], own: list[str], limit: int) -> tuple[int, int, int, int, int] | None:
    """Template words missing, words extra, first and last + 1 word, words matched, if the template stands in own; matches at either end that cost more extra words than they match are left out."""
    match = [m for m in difflib.SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
    best, kept, worth, since = 0, (0, 0), 0, 0
    for k, m in enumerate(match):
        gap = m.b - match[k - 1].b - match[k - 1].size if k else 0
        worth, since = (worth - gap + m.size, since) if k and worth >= gap else (m.size, k)
        if worth > best:
            best, kept = worth, (since, k + 1)
    match = match[slice(*kept)]
    if not match:
        return None
    same = sum(m.size for m in match)
    first, last = match[0].b, match[-1].b + match[-1].size
    missing, extra = len(template) - same, last - first - same
    return (missing, extra, first, last, same) if missing + extra <= limit else None


def licences(text: str, tools: Compressors) -> list[tuple]:
    """(begin, end, licence, size alone, size given, missing, extra, exact) of each notice that is confirmed."""
    words = _words(text)
    own = [w for w, _, _ in words]
    found: list[tuple] = []
    for i, low, high in tools.windows(own):
        alone, ranked = tools.ranked(text[words[low][1] : words[high - 1][2]])
        size = next(s for s, j in ranked if j == i)
        # a block may be wider than the notice: then the reduction counts against the template's share
        share = min(1.0, len(tools.words[i]) / (high - low))
        if alone - size < MIN_GAIN * share * alone:
            continue
        there = confirmed(tools.words[i], own[low:high], tools.limits[i])
        if there is not None:
            missing, extra, first, last, same = there
            begin, end = words[low + first][1], words[low + last - 1][2]
            found.append((missing + extra - same, size, tools.templates[i], begin, (begin, end, tools.templates[i][0], alone, size, missing, extra, missing + extra == 0)))
    out = Disjoint()
    for *_, row in sorted(found):
        out.add(row)
    return out.rows


def _scanner(templates: tuple[tuple[str, str], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(templates)
        cues = tools.cue_pattern()
        names = ["begin", "end", "licence", "size_alone", "size_given", "missing", "extra", "exact"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for whole in batches:
            for batch in text_slices(whole, "text"):
                at, found = [], []
                for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(batch.column("text"), cues), False).to_numpy(zero_copy_only=False)):
                    for row in licences(batch.column("text")[i].as_py(), tools):
                        at.append(i)
                        found.append(row)
                columns = zip(*found) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return scan


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, begin, end, licence, size_alone, size_given, missing, extra, exact): one row for each confirmed notice."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scanner(templates), "doc_id long, begin int, end int, licence string, size_alone int, size_given int, missing int, extra int, exact boolean"
    )
