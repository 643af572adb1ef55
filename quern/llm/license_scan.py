"""License scans by conditional compression.

A text that holds a cue word is aligned with each template by words, over line breaks; the
stretches that differ from it in few words are candidate blocks.  A block is compressed with
its template as a zstandard raw dictionary; blocks are ranked by the bytes that this saves
over compression alone, and confirmed in that order, where none confirmed before lies, by
the exact words that differ between block and template.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import tidy

# License texts, notices and statements, by their SPDX ids.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CONDITIONS = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU_GRANT.format(_GPL, "3"), _GNU_GRANT.format(_GPL, "3") + _GNU_REST.format(_GPL)],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        _GNU_GRANT.format(_GPL, "2"),
        _GNU_GRANT.format(_GPL, "2") + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GNU_GRANT.format(_LGPL, "3"), _GNU_GRANT.format(_LGPL, "3") + _GNU_REST.format(_LGPL)],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU_GRANT.format(_AGPL, "3"), _GNU_GRANT.format(_AGPL, "3") + _GNU_REST.format(_AGPL)],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_GRANT + _BSD_CONDITIONS + _BSD_AS_IS],
    "BSD-3-Clause": [_BSD_GRANT, "Released under the BSD 3-Clause License.", _BSD_GRANT + _BSD_CONDITIONS + _BSD_NAMES + _BSD_AS_IS],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format("Attribution-NonCommercial-NoDerivatives")],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    ],
    "ISC": [_ISC_GRANT, _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS],
    "0BSD": [_ISC_GRANT + ". " + _ISC_AS_IS],
}

CUES = r"(?i)licen[sc]|copyright|spdx|permission|redistribut|public domain|creative commons|\bCC0\b|\bCC BY|waived|free software"
_CUE = re.compile(CUES)
_TOKEN = re.compile(r"\w+(?:[.\-/]\w+)*")
MOST_MISSING = 0.2


def _aligned(wanted: list[int], words: np.ndarray, anywhere: bool) -> np.ndarray:
    """For each end, the words left out or added between wanted and the words from the best start (or the first) to it."""
    place = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64) if anywhere else place.copy()
    for w in wanted:
        step = row + 1
        step[1:] = np.where(words == w, np.minimum(step[1:], row[:-1]), step[1:])
        row = np.minimum.accumulate(step - place) + place
    return row


class Scanner:
    def __init__(self, templates: dict[str, list[str]]) -> None:
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates, self.ids = [], {}
        for name, texts in templates.items():
            for text in texts:
                data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                given = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_dict_id=False)
                wanted = _TOKEN.findall(text.lower())
                self.templates.append((name, wanted, [self.ids.setdefault(w, len(self.ids)) for w in wanted], given))

    def blocks(self, text: str, words: list[tuple[str, int, int]]) -> Iterator[tuple[int, float, int, int, int]]:
        """(saved bytes, their share, template, first word, word after the last) of the stretches that differ from a template in few words."""
        known = np.array([self.ids.get(w, -1) for w, _, _ in words], np.int64)
        there = Counter(known.tolist())
        for i, (_, wanted, ids, given) in enumerate(self.templates):
            most = MOST_MISSING * len(wanted)
            if sum(max(0, n - there[w]) for w, n in Counter(ids).items()) > most:
                continue
            open_ = known.copy()
            ends = _aligned(ids, open_, True)
            while (last := int(ends.argmin())) and ends[last] <= most:
                begin = max(0, last - len(ids) - int(most) - 1)
                first = last - int(_aligned(ids[::-1], open_[begin:last][::-1], False).argmin())
                low = text[words[first][1] : words[last - 1][2]].lower().encode()
                alone, saved = len(self.alone.compress(low)), len(given.compress(low))
                yield alone - saved, 1 - saved / alone, i, first, last
                open_[first:last] = -2  # the next occurrence
                ends = _aligned(ids, open_, True)

    def text(self, text: str | None) -> Iterator[tuple[str, float, int, int, str]]:
        """(license, gain, start, end, differences) of a text, best first."""
        text = text or ""
        if not _CUE.search(text):
            return
        words = [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        taken: list[tuple[int, int]] = []
        for saved, gain, i, first, last in sorted(self.blocks(text, words), key=lambda x: (-x[0], *x[1:])):
            name, wanted, _, _ = self.templates[i]
            if saved <= 0 or any(first < b and a < last for a, b in taken):
                continue
            had = [w for w, _, _ in words[first:last]]
            ops = difflib.SequenceMatcher(None, wanted, had, autojunk=False).get_opcodes()
            changes = [f"-{' '.join(wanted[a:b])} +{' '.join(had[c:d])}" for tag, a, b, c, d in ops if tag != "equal"]
            if any(re.search(r"\d|\b(?:nc|sa|nd|sharealike|noncommercial|noderiv\w*|lesser|affero)\b", c) for c in changes):
                continue  # another version or variant
            taken.append((first, last))
            yield name, round(gain, 4), words[first][1], words[last - 1][2], "; ".join(changes)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each wording of a license found: doc_id, license, gain, start, end (characters), differences.

    gain is the share of the block's compressed size that the template saves.  differences
    lists the words the block leaves out of the template's or adds; differences of version or
    variant are other licenses.  Null, empty and cueless texts give no rows; a text may hold
    several licenses, or one several times, and repeated rows each give theirs.  Whole texts are
    read.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in scanner.text(t.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "gain", "start", "end", "differences"])

    hits = docs.select("doc_id", "text").filter(F.col("text").rlike(CUES))
    return hits.mapInArrow(tidy(run), "doc_id long, license string, gain double, start long, end long, differences string")
