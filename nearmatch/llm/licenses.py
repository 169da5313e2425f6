"""License scans: winnowed template fingerprints, then banded alignment.

Templates are split into words; hashes of their runs of ``GRAM`` words are
winnowed (the smallest of each window of ``WINDOW``) into an inverted index.
Every run of a document's words is looked up. Hits of one template whose
diagonals are near each other make a candidate; a banded sequence alignment of
the template with the document around it (matches, one cost for a word that
differs, is missing or is added) gives the matched words, so that edited
notices are found with their coverage and span. Candidates under
``MIN_COVERAGE`` go, and those in which a word of a license's name or version
(``required``) is not matched or has another word put in beside it; of
overlapping ones the best stays. 2, 2.0 and v2 are one version.

Templates are short notices and identification lines of public licenses, given
below; callers may pass their own. The index is as small as the templates.

Defined results: one row per document and match, and one row with a null
license for documents without any (null and empty texts too); repeated rows
give repeated results; spans count code points of the text, ends are
exclusive; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearmatch.llm.common import table, text_batches

GRAM = 3
WINDOW = 2
#: Words by which an alignment may drift from its diagonal.
BAND = 6
MIN_COVERAGE = 0.8
#: Templates of up to so many words identify a license by every word that isn't in FILLERS.
SHORT = 13
# Words of identification lines that can differ.
FILLERS = frozenset("a an and generic in international into is license licensed of released the this to under unported v version work".split())
# Words of license names.
NAMES = frozenset("affero apache attribution bsd cc cc0 commons creative general gnu isc lesser mit mozilla".split())

# Public license notices and identification lines.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache Software License, Version 2.0.",
    ],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.1."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "MPL-1.1": ["Licensed under the Mozilla Public License, version 1.1."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["Licensed under the zlib License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "Released under the ISC License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivs", "BY-NC-ND": "Attribution-NonCommercial-NoDerivs"}
for _kind, _name in _KINDS.items():
    for _version, _area in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _full = _name.replace("NoDerivs", "NoDerivatives") if _version == "4.0" else _name
        TEMPLATES.setdefault(f"CC-{_kind}-{_version}", [f"Licensed under CC {_kind} {_version}.", f"This work is licensed under a Creative Commons {_full} {_version} {_area} License."])

# Other usual lines and paragraphs.
_MORE = {
    "MIT": [
        "Distributed under the terms of the MIT License.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": ["Licensed under the Apache-2.0 License.", "Distributed under the terms of the Apache License, Version 2.0."],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD License.", "Distributed under the terms of the BSD License."],
    "GPL-2.0": ["Licensed under GPLv2.", "Licensed under the GPLv2.", "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["Licensed under GPLv3.", "Licensed under the GPLv3.", "Licensed under the GNU General Public License v3.0."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License v2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License v3.0."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License v3.0."],
}
for _name, _texts in _MORE.items():
    TEMPLATES.setdefault(_name, []).extend(_texts)
for _name, _texts in TEMPLATES.items():
    if _name != "BSD":  # which names no version, and so is no identifier
        _texts += [f"SPDX-License-Identifier: {_name}{_end}" for _end in (("", "-only", "-or-later") if "GPL" in _name else ("",))]

_word = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

_version = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*").fullmatch


def required(words: list[str]) -> list[bool]:
    """Which words of a template are a license's name or version."""
    out: list[bool] = []
    for w in words:
        follows = bool(out) and out[-1] and w in ("public", "license")
        out.append(follows or bool(_version(w)) or (w not in FILLERS if len(words) <= SHORT else w in NAMES or w.startswith("attribution-")))
    return out


class Scanner:
    """The inverted index of winnowed template fingerprints, and the scan of a text."""

    def __init__(self, templates: dict[str, list[str]], gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = MIN_COVERAGE) -> None:
        self.gram, self.band, self.coverage = gram, band, coverage
        self.ids: dict[str, int] = {}
        self.templates: list[tuple[str, int, list[int], list[bool]]] = []
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for name, texts in templates.items():
            for k, text in enumerate(texts):
                split = _word.findall(text.lower())
                words = [self.id_of(w) for w in split]
                self.templates.append((name, k, words, required(split)))
                grams = [tuple(words[i : i + gram]) for i in range(max(1, len(words) - gram + 1))]
                hashes = [crc32(repr(g).encode()) for g in grams]
                picked = {min(range(i, min(i + window, len(grams))), key=lambda j: (hashes[j], -j)) for i in range(max(1, len(grams) - window + 1))}
                for i in sorted(picked):
                    self.index[grams[i]].append((len(self.templates) - 1, i))
        self.starts = {g[0] for g in self.index}
        self.lengths = sorted({len(g) for g in self.index})  # of templates shorter than a run too

    def id_of(self, word: str) -> int:
        """The number of a template's word; other spellings of a version have the same."""
        if word not in self.ids:
            n = len(self.ids) + 1
            v = _version(word)
            for w in (word, *((v[1], f"{v[1]}.0", f"v{v[1]}", f"v{v[1]}.0") if v else ())):
                self.ids[w] = n
        return self.ids[word]

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(license, template number, start, end, coverage) of each match, by start."""
        if not text:
            return []
        lower = text.lower()
        get = self.ids.get
        if len(lower) == len(text):  # every letter has one small letter: words are at the same places
            ids = [get(w, 0) for w in _word.findall(lower)]
        else:
            ids = [get(w.lower(), 0) for w in _word.findall(text)]
        hits: dict[int, list[int]] = defaultdict(list)
        lengths, index, starts = self.lengths, self.index, self.starts
        for i, w in enumerate(ids):
            if w in starts:
                for n in lengths:
                    for template, at in index.get(tuple(ids[i : i + n]), ()):
                        hits[template].append(i - at)
        if not hits:
            return []
        found = []
        for template, diagonals in hits.items():
            group: list[int] = []
            for d in [*sorted(diagonals), None]:
                if group and (d is None or d - group[0] > self.band):
                    if match := self.align(*self.templates[template][2:], ids, group[len(group) // 2]):
                        found.append((*match, template))
                    group = []
                if d is not None:
                    group.append(d)
        found.sort(key=lambda m: (-m[2] * len(self.templates[m[3]][2]), m[0], m[3]))
        kept: list[tuple[int, int, float, int]] = []
        for m in found:
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
                kept.append(m)
        # the code points of words, found only for texts with a match
        spans = [m.span() for m in _word.finditer(text)]
        return [(self.templates[t][0], self.templates[t][1], spans[a][0], spans[b - 1][1], c) for a, b, c, t in sorted(kept)]

    def align(self, words: list[int], needed: list[bool], ids: list[int], diagonal: int) -> tuple[int, int, float] | None:
        """First word, end and coverage of the best alignment of a template within the band around a diagonal."""
        band, n = self.band, len(words)
        # by offset from the diagonal: (score, matched words, first word, end, matches as (before, template's word, word))
        row: dict[int, tuple] = {k: (0, 0, -1, -1, None) for k in range(-band, band + 1) if 0 <= diagonal + k <= len(ids)}
        best = (0, 0, -1, -1, None)
        for i in range(n):
            new: dict[int, tuple] = {}
            for k in range(-band, band + 1):
                j = diagonal + i + k
                options = []
                if k in row and 0 <= j < len(ids):
                    score, matched, first, end, path = row[k]
                    if ids[j] == words[i]:
                        options.append((score + 2, matched + 1, j if first < 0 else first, j + 1, (path, i, j)))
                    else:
                        options.append((score - 1, matched, first, end, path))
                if k + 1 in row:  # the template's word is missing
                    score, *rest = row[k + 1]
                    options.append((score - 1, *rest))
                if k - 1 in new:  # a word was added
                    score, *rest = new[k - 1]
                    options.append((score - 1, *rest))
                if not options and 0 <= j <= len(ids):
                    options.append((-i, 0, -1, -1, None))
                if options:
                    new[k] = max(options, key=_without_path)
            row = new
            if not row:
                break
            best = max(best, *row.values(), key=_without_path)
        if best[2] < 0 or best[1] / n < self.coverage:
            return None
        at, path = {}, best[4]
        while path:
            path, i, j = path
            at[i] = j
        for i in range(n):
            if needed[i] and (i not in at or i and needed[i - 1] and at[i] != at[i - 1] + 1):
                return None
        return best[2], best[3], best[1] / n


def _without_path(state: tuple) -> tuple:
    return state[:4]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, template, coverage, span_start, span_end of each match in docs(doc_id, text)."""
    templates = templates or TEMPLATES
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(doc, *m) for m in scanner.scan(text)] or [(doc, None, None, None, None, None)]
            doc, name, number, start, end, coverage = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, b.schema.field(0).type), pa.array(name, pa.string()), pa.array(number, pa.int32()), pa.array(coverage, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "license", "template", "coverage", "span_start", "span_end"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, license string, template int, coverage double, span_start long, span_end long")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return scan_licenses(table(spark, sf_dir, "documents"))
