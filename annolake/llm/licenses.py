"""License scans by patience alignment against templates.

Words of a text and of a template are compared in lower case, without punctuation. Where a
text holds distinctive words of a template close together, that window is aligned with it:
words that are unique in both are anchors, the longest increasing subsequence of their
places is kept, and the gaps between are aligned in the same way; gaps without anchors
match what they have equal at both ends. The share of template words that are matched is
the coverage.

Edge cases: null and empty texts have no licenses; any length of text is scanned whole, in
overlapping windows longer than a template, so notices that follow each other are found each; repeated rows get a row each; an empty table gives an
empty result; extra columns are ignored. A find needs the words that tell its license from its
relatives (a version, "Affero", a clause), and none of theirs may be left over among its matches;
within three words after a negation of the same sentence it is none. Of templates that match the same words, the one
with most matched words wins, then the narrower, then the first by name.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import map_arrow, slices

TOKEN = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: Public license texts and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MIT-notice": "Released under the MIT License",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "CC0-1.0-notice": "This work is marked with CC0 1.0 Universal",
    "Apache-2.0-text": 'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.',
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
}
#: Words that a template has to have matched (they tell it from its relatives), and words that bar it where they are left over among its matches.
DECIDING: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache", "2.0"), "Apache-2.0-header": ("apache", "2.0"), "MIT-notice": ("mit",), "MPL-2.0-notice": ("mozilla", "2.0"), "MPL-2.0-text": ("mozilla", "2.0"), "CC0-1.0": ("cc0",), "CC0-1.0-notice": ("cc0",),
    "GPL-2.0-text": ("2", "1991"), "GPL-3.0-text": ("3", "2007"), "AGPL-3.0-text": ("affero", "3"), "LGPL-3.0-text": ("lesser", "3"), "all-rights-reserved": ("all", "rights", "reserved"),
}
BARRING: dict[str, tuple[str, ...]] = {"GPL-2.0-text": ("affero", "lesser"), "GPL-3.0-text": ("affero", "lesser")}

#: The GNU licenses: name, what it speaks of, its kind, its version. Their notices and short forms differ in these only.
for _name, _what, _kind, _version in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "program", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3")):
    TEMPLATES[f"{_name}-notice"] = (
        f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version. "
        f"This {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {_kind}General Public License for more details."
    )
    TEMPLATES[_name] = f"This work is licensed under the GNU {_kind}General Public License, version {_version}"
    for _form in (_name, f"{_name}-notice"):
        DECIDING[_form] = ("gnu", _version, *(w.lower() for w in _kind.split()))
        BARRING[_form] = tuple(w for w in ("affero", "lesser") if w not in _kind.lower())

#: Creative Commons 4.0: the short name and the words of each kind.
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_short}-4.0"] = f"Licensed under CC {_short} 4.0"
    TEMPLATES[f"CC-{_short}-4.0-notice"] = f"This work is licensed under the Creative Commons {_long} 4.0 International License"
    DECIDING[f"CC-{_short}-4.0"], DECIDING[f"CC-{_short}-4.0-notice"] = ("cc", _short.lower(), "4.0"), (_long.lower(), "4.0")

#: The two BSD licenses: the third clause tells them apart.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
)
TEMPLATES["BSD-2-Clause"], TEMPLATES["BSD-3-Clause"] = _BSD[0] + _BSD[2], "".join(_BSD)
DECIDING["BSD-3-Clause"], BARRING["BSD-2-Clause"] = ("neither", "endorse", "promote"), ("neither", "endorse", "promote")

#: A find right after one of these is none: the text says that the license does not hold.
SENTENCE = re.compile(r"[.;:!?\n]")
NEGATIONS, NEGATED = frozenset(("not", "never", "no", "neither", "isn't", "aren't", "wasn't", "weren't", "longer")), 3
#: Common words, which say nothing about a license.
COMMON = frozenset("a above all an and any are as at be but by can for form from if in include included including is it list may must new not of on one or other out provided see shall that the these this to use used version was which will with without you your".split())

Pairs = list[tuple[int, int]]


def increasing(pairs: Pairs) -> Pairs:
    """The longest chain of pairs, sorted by their first place, whose second places increase (patience sorting)."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(x: list[str], y: list[str]) -> Pairs:
    """Places of equal words in x and y, increasing in both, by patience alignment."""
    out: Pairs = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(x[a:b]), Counter(y[c:d])
        place = {w: k for k, w in enumerate(y[c:d], c) if right[w] == 1}
        anchors = increasing([(k, place[x[k]]) for k in range(a, b) if left[x[k]] == 1 and x[k] in place])
        at = (a, c)
        for k, m in anchors:
            out.append((k, m))
            todo.append((at[0], k, at[1], m))
            at = (k + 1, m + 1)
        if anchors:
            todo.append((at[0], b, at[1], d))
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    marks: frozenset  # distinctive words
    needed: frozenset
    barred: frozenset


@dataclass(frozen=True)
class Find:
    name: str
    start: int
    end: int
    matched: int
    coverage: float


@cache
def templates() -> tuple[list[Template], dict[str, list[int]]]:
    """The templates, and for each distinctive word the templates that have it."""
    made = []
    for name, text in sorted(TEMPLATES.items()):
        own = [w.lower() for w in TOKEN.findall(text)]
        made.append(Template(name, own, frozenset(w for w in own if w not in COMMON and len(w) > 1), frozenset(DECIDING.get(name, ())), frozenset(BARRING.get(name, ()))))
    return made, {w: [k for k, t in enumerate(made) if w in t.marks] for t in made for w in t.marks}


def runs(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Runs of places with no gap over `reach`, as (first, last)."""
    first = last = places[0]
    for at in places[1:] + [places[-1] + reach + 1]:
        if at - last > reach:
            yield first, last
            first = at
        last = at


def windows(first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a run with some words around, as (first, last): the whole if it is short, else windows of two widths.

    Each place is the start, by a quarter of `size`, of a window that holds little more than
    a template (so that a notice next to another is met apart) and of one that holds a
    template with as many words put in.
    """
    if last - first < 2 * size:
        yield first, last
    step = max(1, size // 4)
    for width in (size + max(2, step), 2 * size):
        if last - first >= width:
            for at in range(first, last - width + step + 1, step):
                yield at, min(at + width, last)


def near_the_rest(pairs: Pairs, reach: int) -> Pairs:
    """pairs without those at the ends that are more than `reach` words off: these are chance."""
    a, b = 0, len(pairs)
    while b - a > 1 and pairs[a + 1][0] - pairs[a][0] > reach:
        a += 1
    while b - a > 1 and pairs[b - 1][0] - pairs[b - 2][0] > reach:
        b -= 1
    return pairs[a:b]


def scan(text: str, least: float = 0.75) -> list[Find]:
    """License finds in a text, by place; those that overlap a better one are left out."""
    known, by_word = templates()
    spots = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    own = [text[a:b].lower() for a, b in spots]
    if not by_word.keys() & set(own):
        return []
    places: dict[int, list[int]] = {}
    for at, word in enumerate(own):
        for k in by_word.get(word, ()):
            places.setdefault(k, []).append(at)
    found: list[tuple[Find, int, int]] = []
    for k, at in places.items():
        t = known[k]
        size = len(t.words)
        reach = max(4, size // 3)
        for first, last in ((a, b) for x, y in runs(at, reach) for a, b in windows(max(0, x - 6), min(len(own) - 1, y + 6), size)):
            inside = {own[p] for p in at[bisect.bisect_left(at, first) : bisect.bisect_right(at, last)]}
            if len(inside) < least * len(t.marks) * 0.6:
                continue
            pairs = near_the_rest([(p + first, q) for p, q in aligned(own[first : last + 1], t.words)], reach)
            if len(pairs) >= least * size:
                a, b = pairs[0][0], pairs[-1][0]
                matched = {p for p, _ in pairs}
                if not t.needed <= {own[p] for p in matched} or not t.barred.isdisjoint(own[p] for p in range(a, b + 1) if p not in matched):
                    continue
                if any(own[p] in NEGATIONS and not SENTENCE.search(text, spots[p][1], spots[a][0]) for p in range(max(0, a - NEGATED), a)):
                    continue
                found.append((Find(t.name, spots[a][0], spots[b][1], len(pairs), len(pairs) / size), a, b))
    best: list[tuple[Find, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[0].matched, -f[0].coverage, f[2] - f[1], f[0].name, f[1])):
        if not any(f[1] <= g[2] and g[1] <= f[2] for g in best):
            best.append(f)
    return sorted((f[0] for f in best), key=lambda f: f.start)


def scan_licenses(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, n_licenses, licenses (distinct names, sorted), finds (name:start:end:coverage), best_coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                found = [scan(t, least) for t in texts]
                yield pa.record_batch([
                    pa.array(keys, pa.int64()), pa.array([len(f) for f in found], pa.int32()),
                    pa.array([",".join(sorted({x.name for x in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{x.name}:{x.start}:{x.end}:{x.coverage:.3f}" for x in f) for f in found], pa.string()),
                    pa.array([max((x.coverage for x in f), default=0.0) for f in found], pa.float64()),
                ], ["doc_id", "n_licenses", "licenses", "finds", "best_coverage"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_licenses int, licenses string, finds string, best_coverage double")
