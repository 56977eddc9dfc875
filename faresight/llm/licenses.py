"""License scan by patience alignment of texts with license templates.

Words that occur exactly once in the text and once in the template anchor the
alignment; the longest increasing subsequence of the anchors keeps their order, and each gap between
kept anchors is aligned again by the same rule with the words unique in that gap (common words at
a gap's ends are taken first, as in the usual form of the method).
Where copies of a template follow each other no word is unique; there a rare word of the
template is pinned to each of its places in turn and both sides are aligned by the same rule.
A template's coverage is the share of its words that are aligned; the best
template of a text is reported when at least ``MIN_COVERAGE`` of it is found, and beside it every notice that
reaches that.

Texts are read where they are, without a shuffle. A text can only cover enough of
a template if it holds enough of its words, so the few rarest word sets
of the templates are looked up first (exactly that bound, no guess) and the others
are not aligned. Defined cases: null or empty text has no license; ties between templates
go to the longer one, then the name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.8

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public "
    "License as published by the Free Software Foundation; either version {version} of the License, or (at your option) "
    "any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License "
    "for more details.")
# Short license notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."),
    "BSD warranty": (
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied "
        "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any "
        "direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
        "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however "
        "caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or "
        "otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "GPL-2.0 header": _GNU.format(what="program", name="General", version="2"),
    "GPL-3.0 header": _GNU.format(what="program", name="General", version="3"),
    "LGPL-2.1 header": _GNU.format(what="library", name="Lesser General", version="2.1"),
    "LGPL-3.0 header": _GNU.format(what="library", name="Lesser General", version="3"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "All rights reserved": "All rights reserved.",
}

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops, pile, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            pile.append(i)
        else:
            tops[k], pile[k] = v, i
        back[i] = pile[k - 1] if k else -1
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str], at: int = 0, to: int = 0) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, rising in both; places count from ``at`` and ``to``."""
    out, todo = [], [(0, len(text), 0, len(template))]
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
        n, m = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(text[a:b], a) if n[w] == 1 and m.get(w) == 1}
        anchors = [(place[w], k) for k, w in enumerate(template[c:d], c) if w in place]
        kept = [anchors[k] for k in _rising([x for x, _ in anchors])]
        for x, y in kept:
            todo.append((a, x, c, y))
            out.append((x, y))
            a, c = x + 1, y + 1
        if kept:
            todo.append((a, b, c, d))
    return sorted((x + at, y + to) for x, y in out)


def needed(templates: dict[str, list[str]], coverage: float) -> list[str]:
    """Words of which a text must hold at least one to reach the coverage of any template.

    Per template, its least common words until more than 1 - coverage of it would be missing without them.
    """
    seen = Counter(w for t in templates.values() for w in set(t))
    out = set()
    for t in templates.values():
        n, have = Counter(t), 0
        for w in sorted(n, key=lambda w: (-len(w), seen[w], w)):
            out.add(w)
            have += n[w]
            if len(t) - have < coverage * len(t):
                break
    return sorted(out)


def _pinned(text: list[str], t: list[str], k: int, j: int, places: list[int], own: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs with text[k] on t[j]; ``places`` and ``own`` are where that word stands in the text and in ``t``.

    Each side is aligned twice and the better result stays: on as many words as the template has there, and up to
    the occurrence of the word that must belong to another copy (at most twice the template's length).
    """
    at, i, reach = bisect_left(places, k), own.index(j), 2 * len(t)
    before, after = at - i - 1, at + len(own) - i
    a = max(0, k - reach, places[before] + 1 if before >= 0 else 0)
    b = min(len(text), k + reach + 1, places[after] if after < len(places) else len(text))
    left = max((align(text[x:k], t[:j], x) for x in {max(0, k - j), a}), key=_worth)
    right = max((align(text[k + 1:x], t[j + 1:], k + 1, j + 1) for x in {min(len(text), k + len(t) - j), b}), key=_worth)
    return left + [(k, j)] + right


def _worth(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    return len(pairs), pairs[0][0] - pairs[-1][0] if pairs else 0


def _copies(words: list[str], at: dict[str, list[int]], t: list[str], must: list[str], coverage: float):
    """(share, first aligned word, last aligned word + 1) of the copies of ``t`` that reach the coverage.

    The template is aligned where its words are dense: around the rarest words of it that the text holds, as far as it
    is long on either side (twice that, for inserted words). Copies that follow each other leave no
    word unique in such a span, so the template is also aligned with each rarest word pinned to each of its places:
    a copy that reaches the coverage holds at least one of these.
    """
    size, times = len(t), Counter(t)
    enough = lambda a, b: sum(min(n, times[w]) for w, n in Counter(words[a:b]).items() if w in times) >= coverage * size
    reach, spans, out = 2 * size, [], []
    for k in sorted(k for w in must for k in at.get(w, ())):
        if spans and k - reach <= spans[-1][1]:
            spans[-1][1] = k + reach
        else:
            spans.append([max(0, k - reach), k + reach])
    for a, b in spans:
        pairs = align(words[a:b], t, a)
        if pairs and len(pairs) >= coverage * size:
            out.append((len(pairs) / size, pairs[0][0], pairs[-1][0] + 1))
    whole: list[tuple[int, int]] = []  # complete copies: their words need no other pin
    for w in must:
        own = [j for j, x in enumerate(t) if x == w]
        for k in at.get(w, ()):
            n = bisect_left(whole, (k + 1,)) - 1
            if n >= 0 and k < whole[n][1] or not enough(max(0, k - reach), k + reach + 1):
                continue
            for j in own:
                pairs = _pinned(words, t, k, j, at[w], own)
                if len(pairs) >= coverage * size:
                    out.append((len(pairs) / size, pairs[0][0], pairs[-1][0] + 1))
                    if len(pairs) == size == pairs[-1][0] + 1 - pairs[0][0]:
                        insort(whole, out[-1][1:])
                        break
    return out


def all_licenses(text: str, templates: dict[str, list[str]], coverage: float):
    """(name, coverage, first aligned word, last aligned word + 1) of every notice, the best first.

    Copies of one template do not overlap; of equal ones the densest counts, then the first. Notices of
    different templates may (a sentence of a longer notice, two versions of one license).
    """
    words = license_words(text)
    at: dict[str, list[int]] = {}
    known = {w for t in templates.values() for w in t}
    for k, w in enumerate(words):
        if w in known:
            at.setdefault(w, []).append(k)
    out = []
    for name, t in templates.items():
        if sum(n for w, n in Counter(t).items() if w in at) < coverage * len(t):
            continue
        own: list[tuple[int, int]] = []
        for share, a, b in sorted(set(_copies(words, at, t, needed({name: t}, coverage), coverage)),
                                  key=lambda c: (-c[0], c[2] - c[1], c[1])):
            k = bisect_left(own, (a, b))
            if (k == 0 or own[k - 1][1] <= a) and (k == len(own) or b <= own[k][0]):
                own.insert(k, (a, b))
                out.append((-share, -len(t), name, b - a, a))
    return [(name, -share, a, a + n) for share, _, name, n, a in sorted(out)]


def best_license(text: str, templates: dict[str, list[str]], coverage: float):
    """The best of ``all_licenses``, or None."""
    return next(iter(all_licenses(text, templates, coverage)), None)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word, notices) per row of ``docs``.

    The first four are of the best notice, null where no license is found; ``notices`` has all, by place.
    """
    t = {k: license_words(v) for k, v in (templates or TEMPLATES).items()}
    must = needed(t, coverage)
    pattern = "|".join(re.escape(w) for w in must)
    d = docs.select("doc_id", "text", F.coalesce(F.lower("text").rlike(pattern), F.lit(False)).alias("may"))
    d = d.select("doc_id", F.when(F.col("may"), F.col("text")).alias("text"))

    fields = ["license", "coverage", "start_word", "end_word"]
    kind = pa.struct(list(zip(fields, (pa.string(), pa.float64(), pa.int64(), pa.int64()))))
    struct = "license string, coverage double, start_word bigint, end_word bigint"

    def run(batches):
        for b in batches:
            found = [[] if x is None else all_licenses(x, t, coverage) for x in b.column(1).to_pylist()]
            rows = [f[0] if f else (None,) * 4 for f in found]
            every = [[dict(zip(fields, c)) for c in sorted(f, key=lambda c: (c[2:], c[0]))] for f in found]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(every, pa.list_(kind))],
                names=["doc_id", *fields, "notices"])

    return d.mapInArrow(run, f"doc_id bigint, {struct}, notices array<struct<{struct.replace(' ', ': ').replace(',: ', ', ')}>>")
