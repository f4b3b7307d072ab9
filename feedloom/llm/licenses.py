"""License notices: fixed phrases, completed by an exact set-similarity join of text blocks with notice templates.

A template is the text of a public notice, or the name of a license, as the set of its runs of RUN words (of itself, if it has
fewer): order counts. A block is any stretch of a text as long as the template. It meets the template if it holds at least
CONTAINMENT of the template's runs. The runs of all templates are ordered by their frequency in all documents, rarest first. Prefix
filter: with n runs of which m must be met, a block that misses the first n - m + 1 of that order can't qualify, so only blocks around
those are looked at. Length filter: a text of fewer than m runs has none. Positional filter: the prefix runs met around a place,
with all runs behind the prefix, must reach m. What is left is counted exactly. No block is lost by any filter.

Notices of a family share much of their wording, so a block counts for its best template alone: of blocks that overlap the one
with the most runs met stays (ties: the larger share, then the order of the templates).

Edge cases: null or empty text has no words. Places are word numbers from 0. Repeated rows are each answered. Templates
are few and fixed, so each task holds them, and their frequencies are all that comes to the driver; memory is one document's words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, texts

CONTAINMENT, RUN = 0.8, 3
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes with A-Z lowered
# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Names of licenses, and the wording of public license notices, with their labels.
TEMPLATES = (
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", "Mozilla Public License"),
    ("mpl", "Mozilla license"),
    ("bsd", "BSD license"),
    ("bsd", "BSD 2-Clause"),
    ("bsd", "BSD 3-Clause"),
    ("isc", "ISC license"),
    ("boost", "Boost Software License"),
    ("epl", "Eclipse Public License"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc0", "CC0 1.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def runs_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """The runs of RUN words by place; a shorter list is one run."""
    return [tuple(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1))] if words else []


class Runs:
    """The runs of all templates, by their first word; short templates are runs of fewer words."""

    def __init__(self):
        self.templates = [(label, runs_of(words_of(t))) for label, t in TEMPLATES]
        self.by: dict[bytes, set[tuple[bytes, ...]]] = {}
        for _, runs in self.templates:
            for r in runs:
                self.by.setdefault(r[0], set()).add(r)

    def places(self, words: list[bytes], known=None) -> list[tuple[int, tuple[bytes, ...]]]:
        """(place, run) of the runs of `known` (all, by first word) in a text."""
        known = self.by if known is None else known
        if known.keys().isdisjoint(words):
            return []
        out = []
        for i, w in enumerate(words):
            if w in known:
                some = known[w]
                out += [(i, r) for k in range(1, RUN + 1) if i + k <= len(words) and (r := tuple(words[i : i + k])) in some]
        return out


def frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[tuple[bytes, ...], int]:
    """How often each run of a template stands in all documents. The result has one row a run."""

    def make():
        runs = Runs()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            c: Counter = Counter()
            for t in batch.column("text").to_pylist():
                c.update(r for _, r in runs.places(words_of(t)))
            return pa.RecordBatch.from_arrays([pa.array([b" ".join(r).decode() for r in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["run", "n"])

        return one

    got = map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["run"].encode().split()): r["n"] for r in got}


class Join:
    """The templates in global order with their prefixes, and the join of one document's blocks."""

    def __init__(self, freq: dict[tuple[bytes, ...], int], containment: float = CONTAINMENT):
        self.runs = Runs()
        self.templates = []
        self.prefix: dict[bytes, set] = {}
        self.of: dict[tuple[bytes, ...], list[int]] = {}
        for k, (label, runs) in enumerate(self.runs.templates):
            order = sorted(set(runs), key=lambda r: (freq.get(r, 0), r))
            n = len(order)
            m = math.ceil(containment * n - 1e-9)
            first = order[: n - m + 1]
            self.templates.append((label, frozenset(order), frozenset(first), n, m, len(runs)))
            for r in first:
                self.prefix.setdefault(r[0], set()).add(r)
                self.of.setdefault(r, []).append(k)
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def base(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, last word, label) of every place of a phrase."""
        out = []
        for p, label in self.phrases:
            at = -1
            for _ in range(words.count(p[0])):
                at = words.index(p[0], at + 1)
                if words[at : at + len(p)] == p:
                    out.append((at, at + len(p) - 1, label))
        return out

    def met(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(runs met, template, first word, last word + 1) of every block that meets its template."""
        around: dict[int, list[int]] = {}
        for i, r in self.runs.places(words, self.prefix):
            for k in self.of.get(r, ()):
                around.setdefault(k, []).append(i)
        out = []
        for k, at in around.items():
            _, whole, prefix, n, m, length = self.templates[k]
            if len(words) < m:
                continue
            known: dict[bytes, set] = {}
            for r in whole:
                known.setdefault(r[0], set()).add(r)
            begin = 0
            while begin < len(at):
                stop = begin + 1
                while stop < len(at) and at[stop] - at[stop - 1] < length:
                    stop += 1
                low, high = max(0, at[begin] - length + 1), min(len(words), at[stop - 1] + length + RUN - 1)
                found = self.runs.places(words[low:high], known)
                if len({r for _, r in found} & prefix) + n - len(prefix) >= m:
                    out += [(c, k, low + a, low + b) for c, a, b in self.slide(found, length, m)]
                begin = stop
        return out

    @staticmethod
    def slide(found: list[tuple[int, tuple[bytes, ...]]], length: int, m: int) -> list[tuple[int, int, int]]:
        """(different runs met, first word met, last word met + 1) of the blocks of `length` runs, one for each last run met, that meet at least m."""
        held: Counter = Counter()
        out = []
        left = 0
        for p, r in found:
            held[r] += 1
            while found[left][0] <= p - length:
                held[found[left][1]] -= 1
                if not held[found[left][1]]:
                    del held[found[left][1]]
                left += 1
            if len(held) >= m:
                out.append((len(held), found[left][0], p + len(r)))
        return out

    def blocks(self, words: list[bytes]) -> dict[str, float]:
        """Label -> best containment, of the blocks that are the best of those they overlap with, from the best on."""
        best: dict[str, float] = {}
        begins: list[int] = []
        taken: list[tuple[int, int]] = []
        for c, k, a, b in sorted(self.met(words), key=lambda x: (-x[0], -x[0] / self.templates[x[1]][3], x[1], x[2])):
            i = bisect_left(begins, b)
            if i and taken[i - 1][1] > a:
                continue
            begins.insert(i, a)
            taken.insert(i, (a, b))
            label, share = self.templates[k][0], c / self.templates[k][3]
            best[label] = max(best.get(label, 0.0), share)
        return best


def scan(docs: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 where a phrase stands, else the best containment met)."""
    freq = frequencies(docs, id_col, text_col)

    def make():
        join = Join(freq, containment)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                base, met = join.base(words), join.blocks(words)
                labels = {x for _, _, x in base}
                starts = [a for a, _, _ in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(met))), 1.0 if base else max(met.values(), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

        return one

    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
