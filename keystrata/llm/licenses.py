"""License scan by patience alignment.

Where a text has enough words of a template close together, the two are aligned: words that are
unique in both are anchors, the longest increasing subsequence of them is kept, and the gaps
between kept anchors are aligned in the same way, after equal words next to the anchors have
been taken.  The aligned share of the template is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore
from .scratch import reach

#: Least coverage of a template, and words of text per word of template within which it counts.
COVERAGE, SPREAD = 0.85, 1.5


def _gnu(name: str, version: str) -> str:
    """The notice of the GNU licenses; the subject (program, library, a name) is left out, it does not tell them apart."""
    return (
        f"This is free software: you can redistribute it and/or modify it under the terms of the {name} as published by"
        f" the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        " This is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    )


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
    " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
    " materials provided with the distribution."
)
_BSD_ADVERTISING = " All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_NAMES = (
    " Neither the name of nor the names of its contributors may be used to endorse or promote products derived from"
    " this software without specific prior written permission."
)

#: Notices and license texts (fixed values); holders and products are left out of texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
    "all-rights-reserved-notice": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The"
        " above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software."
    ),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations"
        " under the License."
    ),
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + _BSD_NAMES,
    "BSD-4-Clause": _BSD + _BSD_ADVERTISING + _BSD_NAMES,
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "LGPL-2.0": _gnu("GNU Library General Public License", "2"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use"
        " this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT"
        " WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights"
        " and limitations under the License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

#: Reservations rather than licenses: named as the license of a text only where it has no other.
_RESERVED = frozenset({"all-rights-reserved", "all-rights-reserved-notice"})

_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_words(text: bytes) -> list[bytes]:
    """Words in lower case without punctuation at their ends; words of punctuation only are left out."""
    return [x for x in (w.strip(_EDGE) for w in text.lower().split()) if x]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs ``(place in text, place in template)`` of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        chain = _increasing(anchors)
        if not chain:
            continue
        out += chain
        for (i, j), (k, m) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing first members (patience sorting with back links)."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(pairs):
        pile = bisect_left(tops, i)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            top_at.append(n)
        else:
            tops[pile], top_at[pile] = i, n
    chain, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


class Scanner:
    """Templates with their vocabulary."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = sorted(templates)
        self.words = [normal_words(templates[n].encode()) for n in self.names]
        self.need = [int(np.ceil(coverage * len(w) - 1e-9)) for w in self.words]
        every = sorted({w for ws in self.words for w in ws})
        self.number = {w: i for i, w in enumerate(every)}
        self.member = np.zeros((len(every), len(self.names)), bool)
        self.times = np.zeros((len(every), len(self.names)), np.int32)
        for t, ws in enumerate(self.words):
            for w in ws:
                self.member[self.number[w], t] = True
                self.times[self.number[w], t] += 1

    def matches(self, text: str) -> list[tuple[str, float]]:
        """Templates with enough coverage, and the coverage of each; where spans overlap, the best only.

        The best has the most aligned words less words of the template that are missing, so that a
        longer sibling (a further clause, one more word in a name) is not lost to a shorter one.
        """
        found = normal_words(text.encode())
        get = self.number.get
        known = [(i, k) for i, w in enumerate(found) if (k := get(w)) is not None]
        if not known:
            return []
        place = np.array([i for i, _ in known])
        number = np.array([k for _, k in known])
        bound = self.times[np.unique(number)].sum(axis=0)  # words of the template that the text has at all
        out = []
        for t in np.flatnonzero(bound >= self.need).tolist():
            length = len(self.words[t])
            for a, b in self._regions(place[self.member[number, t]], self.need[t], length):
                pairs = align(found[a:b], self.words[t])
                if len(pairs) >= self.need[t]:
                    out.append((length - 2 * len(pairs), -len(pairs) / length, self.names[t], a + pairs[0][0], a + pairs[-1][0]))
        taken: list[tuple[int, int]] = []
        best: dict[str, float] = {}
        for _, share, name, a, b in sorted(out):
            if all(b < c or d < a for c, d in taken):
                taken.append((a, b))
                best[name] = max(best.get(name, 0.0), -share)
        return sorted(best.items())

    @staticmethod
    def _regions(at: np.ndarray, need: int, length: int) -> list[tuple[int, int]]:
        """Spans of text, ``SPREAD`` times as long as the template (and 4 words, unless it is very short), with ``need`` of its words.

        One for each start at a word of the template; a start inside a span with as many words
        or more that begins a quarter of the template earlier at most adds nothing.
        """
        width = int(SPREAD * length) + (4 if length > 4 else 0)
        count = np.searchsorted(at, at + width) - np.arange(len(at))
        out, last, most = [], -width, 0
        for i in np.flatnonzero(count >= need).tolist():
            if at[i] - last <= length // 4 and count[i] <= most:
                continue
            last, most = at[i], count[i]
            out.append((int(at[i]), int(at[i]) + width))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, licenses, license, coverage`` for every row of ``docs``; no shuffle.

    ``licenses`` are the names of all templates with enough coverage in order, ``license`` the
    one with the highest coverage (the longest, then the first by name, of equals; reserved rights
    only where there is nothing else) or null, and ``coverage`` its share (0 for none).  A null
    text has no words.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        size = {n: len(w) for n, w in zip(scanner.names, scanner.words, strict=True)}
        for batch in batches:
            listed, best, share = [], [], []
            for text in textcore.as_strings(batch.column("text")).to_pylist():
                found = scanner.matches(text)
                top = min(found, key=lambda m: (m[0] in _RESERVED, -m[1], -size[m[0]], m[0]), default=(None, 0.0))
                listed.append([n for n, _ in found])
                best.append(top[0])
                share.append(top[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(listed, pa.list_(pa.string())), pa.array(best, pa.string()), pa.array(share, pa.float64())],
                names=["doc_id", "licenses", "license", "coverage"],
            )

    reach(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, licenses array<string>, license string, coverage double"
    )
