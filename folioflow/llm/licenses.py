"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are reduced to words (lower-cased letters and digits) and to hashes of
``GRAM`` successive words, of which winnowing keeps the smallest of every
``WINNOW`` neighbours. These fingerprints form an inverted index from hash to
(template, position); its size is bounded by the templates, not by the corpus.
In a document all grams are looked up, so every kept fingerprint of a copied
passage is found. Hits of one template on nearby diagonals open a candidate; a
local alignment in a band of ``BAND`` words, or a tenth of a longer template,
around the diagonal (match 2, anything else -1) then gives the matched words, the
covered share of the template, and the span in the document in code points, end
exclusive. Passed over are only candidates for which the document, or the band, lacks
the words to cover the template.

Templates are short notices, the grants and notices of the GNU licenses by version,
and full terms (``license_texts``: public texts as published). The terms of the
AGPL are those of the GPL but for its name and section 13; no preamble is held.

Defined results: null and empty texts have no match; of overlapping matches of
several templates the one with most matched words stays, of equal ones that of the
larger covered share, ties to the name first in code-point order; repeated rows each give their matches; null ids are kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .shingles import gram_hashes, word_hashes

GRAM, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
SCHEMA = "doc_id long, license string, start long, end long, matched_words long, template_words long, coverage double"
_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")

#: Fixed texts: public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


_MIT, _ISC = TEMPLATES["MIT-text"], TEMPLATES["ISC"]
#: The permission without the rest, as it was held before and is still found where a text is cut off.
TEMPLATES["MIT-grant"] = _MIT[: _MIT.index(", subject to the")]
TEMPLATES["ISC-grant"] = _ISC[: _ISC.index(" THE SOFTWARE IS")]

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES |= {"BSD-2-Clause": _BSD + _BSD_END, "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END}

_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as "
    "published by the Free Software Foundation, "
)
_LATER, _ONLY = "either version {1} of the License, or (at your option) any later version.", "version {1} of the License."
_NO_WARRANTY = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
for _short, _name, _versions in (
    ("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")),
    ("AGPL", "Affero General Public License", ("3",)),
):
    for _v in _versions:
        for _which, _clause in (("or-later", _LATER), ("only", _ONLY)):
            TEMPLATES[f"{_short}-{_v}-{_which}-grant"] = (_GRANT + _clause).format(_name, _v)
            TEMPLATES[f"{_short}-{_v}-{_which}-notice"] = (_GRANT + _clause + _NO_WARRANTY).format(_name, _v)
    if _short != "GPL":
        TEMPLATES[f"{_short}-notice"] = _GRANT.format(_name)

_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently
offer all users interacting with it remotely through a computer network (if your version supports such interaction) an
opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a
network server at no charge, through some standard or customary means of facilitating copying of software. This
Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public
License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work
licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work.
The terms of this License will continue to apply to the part which is the covered work, but the work with which it is
combined will remain governed by version 3 of the GNU General Public License.
"""


def _full_terms() -> dict[str, str]:
    """The files of ``license_texts``, without preambles and without how to apply them."""
    out = {}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        text = text[: end.start()] if end else text
        begin = re.search(r"^.*TERMS AND CONDITIONS.*$", text, re.M)
        out[f"{file.stem}-text"] = text[begin.start() :] if begin else text
    parts = re.split(r"(?m)^  (?=1[34]\. )", out["GPL-3-text"])
    own = [x.replace("GNU General Public License", "GNU Affero General Public License") for x in (parts[0], parts[2])]
    out["AGPL-3-text"] = own[0] + _AGPL_13 + own[1]
    return out


TEMPLATES |= _full_terms()


def _hashes(words: list[str]) -> np.ndarray:
    return word_hashes(" ".join(words).encode())


def winnow(grams: np.ndarray, window: int = WINNOW) -> list[int]:
    """Positions of the smallest hash of every ``window`` neighbours, the last of equal ones."""
    if not len(grams):
        return []
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    best = window - 1 - np.argmin(views[:, ::-1], axis=1) + np.arange(len(views))
    return np.unique(best).tolist()


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> tuple[list, list, np.ndarray, dict]:
    """Template word hashes, their counts, all fingerprints sorted, and their places."""
    bodies, counts, places = [], [], {}
    for i, (_, text) in enumerate(templates):
        words = _hashes(_WORDS.findall(text.lower()))
        bodies.append(words)
        counts.append(np.unique(words, return_counts=True))
        grams = gram_hashes(words, GRAM)
        for at in winnow(grams):
            places.setdefault(int(grams[at]), []).append((i, at))
    return bodies, counts, np.sort(np.array(list(places), np.uint64)), places


def common_words(counts: tuple[np.ndarray, np.ndarray], kinds: np.ndarray, n: np.ndarray) -> int:
    """Most words that a document with ``n`` words of each of ``kinds`` can match of a template with these counts."""
    at = np.minimum(np.searchsorted(kinds, counts[0]), len(kinds) - 1)
    return int(np.where(kinds[at] == counts[0], np.minimum(n[at], counts[1]), 0).sum())


def near_words(template: np.ndarray, kinds: np.ndarray, places: np.ndarray, diagonal: int, band: int) -> int:
    """Words of the template that the document has anywhere in the band, which no alignment in it exceeds.
    ``places``: sorted numbers of each word's kind and position."""
    kind = np.searchsorted(kinds, template)
    has = kinds[np.minimum(kind, len(kinds) - 1)] == template
    at = np.arange(len(template)) + diagonal
    low = (kind << 32) + np.maximum(at - band, 0)
    first = places[np.minimum(np.searchsorted(places, low), len(places) - 1)]
    return int((has & (first >= low) & (first <= (kind << 32) + at + band)).sum())


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment near ``diagonal`` (document minus template position):
    matched words, first and last document word (end exclusive)."""
    width, origin = 2 * band + 1, diagonal - band
    # A cell is one number: score, matched words, first word counted from ``origin``; 0 is an empty one.
    one, hit = 1 << 42, (2 << 42) + (1 << 21)
    k = np.arange(width)
    slope = k * one
    padded = np.zeros(len(template) + width, np.uint64)
    inside = np.zeros(len(padded), bool)
    low, high = max(0, origin), min(len(words), origin + len(padded))
    if low < high:
        padded[low - origin : high - origin] = words[low:high]
        inside[low - origin : high - origin] = True
    cells = np.zeros(width + 1, np.int64)
    best = (-1, 0, 0)
    for i, t in enumerate(template):
        up = cells[:width]
        now = np.where(up > 0, up, i + k) + np.where((padded[i : i + width] == t) & inside[i : i + width], hit, -one)
        now = np.maximum(now, cells[1:] - one)
        now = np.maximum.accumulate(now + slope) - slope
        now[(now < one) | ~inside[i : i + width]] = 0
        cells[:width] = now
        at = int((now >> 21).argmax())
        if now[at] and now[at] >> 21 > best[0]:
            best = (int(now[at] >> 21), int(now[at] & (1 << 21) - 1) + origin, i + at + origin + 1)
    return (best[0] & (1 << 21) - 1, best[1], best[2]) if best[0] > 0 else (0, 0, 0)


def matches(text: str | None, templates: tuple[tuple[str, str], ...], coverage: float = COVERAGE) -> list[tuple]:
    """``license, start, end, matched words, template words, coverage`` of each match in a text."""
    if not text:
        return []
    bodies, counts, fingerprints, places = _index(templates)
    lowered = text.lower()
    if len(lowered) != len(text):  # keep offsets: lower only what stays one code point
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = list(_WORDS.finditer(lowered))
    words = _hashes([m.group() for m in found])
    if len(words) < GRAM:
        return []
    grams = gram_hashes(words, GRAM)
    slots = np.minimum(np.searchsorted(fingerprints, grams), len(fingerprints) - 1)
    hits = np.flatnonzero(fingerprints[slots] == grams)
    diagonals: dict[int, list[int]] = {}
    for at in hits.tolist():
        for i, place in places[int(grams[at])]:
            diagonals.setdefault(i, []).append(at - place)
    if not diagonals:
        return []
    kinds, kind, times = np.unique(words, return_inverse=True, return_counts=True)
    spots = np.sort((kind.astype(np.int64) << 32) + np.arange(len(words)))
    out = []
    for i, ds in diagonals.items():
        least, last, band = coverage * len(bodies[i]), None, max(BAND, len(bodies[i]) // 10)
        if len(words) < least or common_words(counts[i], kinds, times) < least:
            continue
        opened = []
        for d in sorted(set(ds)):
            if last is None or d - last > band // 2:
                last = d
                opened.append((near_words(bodies[i], kinds, spots, d, band), d))
        # Most promising first; words of matches found are blanked, so that further copies in a band come next.
        left = words.copy()
        for most, d in sorted(opened, reverse=True):
            low, high = max(0, d - band), min(len(words), d + len(bodies[i]) + band)
            while most >= least and np.count_nonzero(left[low:high]) >= least:
                n, first, end = align(bodies[i], left, d, band)
                if n < least:
                    break
                left[first:end] = 0
                out.append((templates[i][0], found[first].start(), found[end - 1].end(), n, len(bodies[i]), n / len(bodies[i])))
    chosen: list[tuple] = []
    starts: list[int] = []
    for x in sorted(out, key=lambda x: (-x[3], -x[5], x[0], x[1])):
        at = bisect_left(starts, x[1])
        if (not at or chosen[at - 1][2] <= x[1]) and (at == len(chosen) or chosen[at][1] >= x[2]):
            starts.insert(at, x[1])
            chosen.insert(at, x)
    return chosen


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match; see the module's text."""
    frozen = tuple(sorted(templates.items()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *m) for i, t in zip(ids, batch.column("text")) for m in matches(t.as_py(), frozen, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_batches(docs.select("doc_id", "text"), of, SCHEMA)
