"""License scans by conditional compression: templates as raw dictionaries rank candidates, word differences decide."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_type, lean, load

#: The texts and notices of public licences, by SPDX identifier. One licence may have several notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS",
    ),
)
#: Words that name a licence. A change of one is another licence, never a variant of wording.
NAMES = frozenset("apache bsd mit isc mpl mozilla gnu gpl lgpl agpl lesser affero general cc cc0 by nc nd sa public domain unencumbered clause universal software redistribution not no except".split())
TOKEN = re.compile(r"\w+", re.UNICODE)
CACHE = 50_000


class Scanner:
    """Finds notices in texts. templates: (licence, notice); tolerance: the largest share of a notice's words that may differ, below 1.

    A notice with at most d differing words keeps all but 2 d of its pairs of neighbouring words, within as many words as it has and d more. Regions where that many
    of its pairs lie, and each of its words that must not differ, are compared with it word by word, at any length of the text; nothing else can be confirmed. Where d
    is so large that no pair need be left, its single words are counted instead.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, tolerance: float = 0.25):
        self.names = [n for n, _ in templates]
        self.words = [TOKEN.findall(t.lower()) for _, t in templates]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.tuned = []
        for w in self.words:
            d = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.tuned.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False))
        self.most = [int(tolerance * len(w)) for w in self.words]
        self.fixed = [{x for x in w if self.telling(x)} for w in self.words]
        # (pairs or words that must lie together, how far the first and the last of them may be apart)
        self.need: list[tuple[int, int]] = []
        self.pairs: dict[tuple[str, str], list[int]] = {}
        self.single: dict[str, list[int]] = {}
        for i, (w, d) in enumerate(zip(self.words, self.most)):
            by_pair = len(w) - 1 - 2 * d >= 1
            self.need.append((len(w) - 1 - 2 * d, len(w) + d - 2) if by_pair else (max(1, len(w) - d), len(w) + d - 1))
            for x in set(zip(w, w[1:])) if by_pair else set(w):
                (self.pairs if by_pair else self.single).setdefault(x, []).append(i)
        self.cache: dict[tuple[str, ...], list] = {}

    @staticmethod
    def telling(word: str) -> bool:
        """A word that names a licence, or a number: with another one it is another licence."""
        return word in NAMES or any(c.isdigit() for c in word)

    def regions(self, words: list[str]) -> dict[int, list[list[int]]]:
        """template -> regions of the words, as first and end, apart from each other, that hold whatever it could confirm."""
        hits: dict[int, list[int]] = {}
        for cues, found in ((self.pairs, zip(words, words[1:])), (self.single, words)):
            if cues:
                for k, x in enumerate(found):
                    if x in cues:
                        for i in cues[x]:
                            hits.setdefault(i, []).append(k)
        out: dict[int, list[list[int]]] = {}
        for i, at in hits.items():
            need, apart = self.need[i]
            most = len(self.words[i]) + self.most[i]
            for first, last in zip(at, at[need - 1 :]):
                if last - first <= apart:
                    a, b = max(0, last + 1 - most), min(len(words), first + most)
                    if self.fixed[i].issubset(words[a:b]):
                        own = out.setdefault(i, [])
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(b, own[-1][1])
                        else:
                            own.append([a, b])
        return out

    def blocks(self, text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
        """Candidate blocks, the regions of all templates joined where they overlap: (words, their spans in the text)."""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length when lower-cased; spans must fit the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = TOKEN.findall(low)
        found = sorted(r for own in self.regions(words).values() for r in own)
        if not found:
            return []
        spans = [m.span() for m in TOKEN.finditer(low)]
        joined: list[list[int]] = []
        for a, b in found:
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return [(words[a:b], spans[a:b]) for a, b in joined]

    def saving(self, words: list[str], i: int) -> float:
        """The share of the words' compressed size that a notice as dictionary saves."""
        raw = " ".join(words).encode()
        return 1 - len(self.tuned[i].compress(raw)) / len(self.plain.compress(raw))

    def align(self, words: list[str], i: int) -> list[tuple[int, int, int]]:
        """(differences, first, end) wherever the notice lies in the words with as few differences as are allowed, the fewest first, apart from each other.

        An edit distance of missing and extra words whose beginning and end in the words are free; words that name a licence and numbers can be neither.
        """
        t, most = self.words[i], self.most[i]
        skip = [most + 1 if x in self.fixed[i] else 1 for x in t]
        costs, starts = [0], [0]
        for s in skip:
            costs.append(costs[-1] + s)
            starts.append(0)
        found = []
        for e, w in enumerate(words, 1):
            add = most + 1 if self.telling(w) else 1
            new, begin = [0], [e]
            for j, x in enumerate(t):
                c, b = new[j] + skip[j], begin[j]
                if costs[j + 1] + add < c:
                    c, b = costs[j + 1] + add, starts[j + 1]
                if x == w and costs[j] <= c:
                    c, b = costs[j], starts[j]
                new.append(c)
                begin.append(b)
            costs, starts = new, begin
            if costs[-1] <= most and starts[-1] < e:
                found.append((costs[-1], starts[-1], e))
        out: list[tuple[int, int, int]] = []
        for x in sorted(found):
            if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
                out.append(x)
        return out

    def differences(self, span: list[str], i: int) -> tuple[list[str], list[str]]:
        """The fewest words of the notice that are missing in the span, and words that are extra there."""
        t, most = self.words[i], self.most[i]
        rows = [[0] * (len(span) + 1) for _ in range(len(t) + 1)]
        miss, add = ([most + 1 if self.telling(x) else 1 for x in part] for part in (t, span))
        for j in range(len(t), -1, -1):
            for k in range(len(span), -1, -1):
                if j < len(t) or k < len(span):
                    rows[j][k] = min(
                        rows[j + 1][k] + miss[j] if j < len(t) else 1 << 30,
                        rows[j][k + 1] + add[k] if k < len(span) else 1 << 30,
                        rows[j + 1][k + 1] if j < len(t) and k < len(span) and t[j] == span[k] else 1 << 30,
                    )
        j = k = 0
        missing, extra = [], []
        while j < len(t) or k < len(span):
            if j < len(t) and k < len(span) and t[j] == span[k] and rows[j][k] == rows[j + 1][k + 1]:
                j, k = j + 1, k + 1
            elif j < len(t) and rows[j][k] == rows[j + 1][k] + miss[j]:
                missing.append(t[j])
                j += 1
            else:
                extra.append(span[k])
                k += 1
        return missing, extra

    def reduction(self, words: list[str], i: int) -> int:
        """The bytes by which a notice as raw dictionary makes the compressed words smaller."""
        raw = " ".join(words).encode()
        return len(self.plain.compress(raw)) - len(self.tuned[i].compress(raw))

    def best(self, words: list[str], limit: int) -> tuple[int, int, int] | None:
        """(template, first, end) of the winner in a window, of notices that begin before limit.

        Each region is a candidate block: it is compressed alone and with its template as dictionary. In falling order of the bytes saved (then the longer template, then
        the first in the list) blocks are held against their template word by word, and the first one confirmed wins, where it has the fewest differences.
        """
        ranked = []
        for i, own in self.regions(words).items():
            for a, b in own:
                if a < limit:
                    ranked.append((-self.reduction(words[a:b], i), -len(self.words[i]), i, a, b))
        for _, _, i, a, b in sorted(ranked):
            for _, first, end in self.align(words[a:b], i):
                if a + first < limit:
                    return i, a + first, a + end
        return None

    def scan_block(self, words: list[str]) -> list[tuple[int, int, int, float, list[str], list[str]]]:
        """(first, end, template, saving, missing, extra) of each notice in the block.

        The block is gone through in windows of twice the longest notice that could lie there, each beginning where the one before has its middle, so every notice lies whole
        in the window whose first half it begins in. When a winner is found, what lies before it and after it is gone through again, so a block with
        several notices gives all of them, in time in proportion to its length.
        """
        key = tuple(words)
        if (known := self.cache.get(key)) is not None:
            return known
        span = max((len(self.words[i]) + self.most[i] for i in self.regions(words)), default=0)
        out, todo = [], [(0, len(words))] if span else []
        while todo:
            lo, hi = todo.pop()
            end = min(hi, lo + 2 * span)
            got = self.best(words[lo:end], end - lo if end == hi else span)
            if got is None:
                if end < hi:
                    todo.append((lo + span, hi))
                continue
            i, first, last = got
            found = words[lo + first : lo + last]
            out.append((lo + first, lo + last, i, self.saving(found, i), *self.differences(found, i)))
            todo += [(a, b) for a, b in ((lo, lo + first), (lo + last, hi)) if a < b]
        out.sort()
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[key] = out
        return out

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, licence, exact, missing, extra, saving) of each notice, in order; start and end count code points."""
        out = []
        for words, spans in self.blocks(text or ""):
            for first, end, i, saving, missing, extra in self.scan_block(words):
                out.append((spans[first][0], spans[end - 1][1], self.names[i], not missing and not extra, " ".join(missing), " ".join(extra), saving))
        return out


@lru_cache(4)
def scanner_of(templates: tuple[tuple[str, str], ...], tolerance: float) -> Scanner:
    return Scanner(templates, tolerance)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, tolerance: float = 0.25) -> DataFrame:
    """One row per notice found: id, notice (its number in the text, from 0), start, end (code points), license, exact, missing, extra, saving.

    Candidate blocks lie where a text holds enough pairs of neighbouring words of a template. Each block is compressed with its templates as zstandard raw dictionaries; the
    one that makes it smaller by the most bytes comes first, and wins if exact differences of wording confirm it: at most `tolerance` of its words differ, and none that
    names a licence or is a number; else the next one follows. missing and extra list the differing words, exact says there are none, saving is the share
    of the notice's own compressed size that the template saves. Equal savings: the longer template, then the first in the list.
    Whole texts are read; equal blocks are judged once per worker (a bounded cache). Row-wise: no shuffle, so hot notices need no care.
    Null and empty texts have no notices; null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        scan = scanner_of(templates, tolerance).scan
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                got = scan(t.as_py())
                at += [i] * len(got)
                rows += [(k, *g) for k, g in enumerate(got)]
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.float64()))]], names=names)

    names = ["i", "notice", "start", "end", "license", "exact", "missing", "extra", "saving"]
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"i {id_type(docs, id_col)}, notice long, start long, end long, license string, exact boolean, missing string, extra string, saving double")
    return out.toDF(id_col, *names[1:])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice in documents, whole texts. See license_scan."""
    return license_scan(load(spark, sf_dir, "documents"))
