"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Words are runs of letters or digits in lower case. A text is searched for
passages, shorter or longer than a template, that share enough of its bigrams; a template
whose size no passage of the text can match is pruned beforehand, by the
number of the text's bigrams and by the number that it shares at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .runtime import chunks, clean, ready

#: Least Dice coefficient of a passage with a template.
LEAST = 0.8
#: Notices and texts of public licences, by SPDX identifier; several texts may bear one.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]




def _siblings(known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Licences whose texts differ from a known one in name, version or a clause, by these differences."""
    gnu, bsd = next(t for n, t in known if n == "GPL-3.0-or-later"), next(t for n, t in known if n == "BSD-2-Clause")
    names = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
    out = []
    for name, version in [("GPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]:
        short = version.removesuffix(".0")
        out.append((f"{name}-{version}", f"This work is licensed under the {names[name]}, version {short}."))
        for what in ("program", "library"):
            text = gnu.replace(names["GPL"], names[name]).replace("version 3", f"version {short}").replace("This program", f"This {what}")
            out.append((f"{name}-{version}-or-later", text))
    clause = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    head, tail = bsd.split(" THIS SOFTWARE IS PROVIDED", 1)
    out += [("BSD-3-Clause", f"{head} {clause} THIS SOFTWARE IS PROVIDED{tail}"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.")]
    terms = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for code in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(terms[c] for c in code.split("-"))
        out += [(f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License."), (f"CC-{code}-4.0", f"Licensed under CC {code} 4.0.")]
    return out


TEMPLATES += _siblings(TEMPLATES)
#: Words that tell a licence from its siblings: a passage must hold the template's own ones and no others.
TELLING = ("lesser", "library", "affero", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd", "endorse", "promote")
#: After these words stands a version, which must be the template's.
BEFORE_VERSION = ("version", "v")
#: Templates of so few words are names: their numbers must be in the passage as well.
NAME_WORDS = 20


@dataclass(frozen=True)
class Library:
    """Templates as bigrams: name, number, and their sorted distinct bigrams with how often each occurs."""

    names: list[str]
    sizes: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    every: np.ndarray
    signs: list[tuple[frozenset[int], frozenset[int], frozenset[int]]]


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all bigrams, each text's first (one more at the end), where the two words begin and end, and where texts begin."""
    codes, starts = tv.points(texts)
    codes = tv.lower(codes)
    kind = tv.classes()[codes]
    begin, end = tv.spans((kind == tv.LETTER) | (kind == tv.NUMBER))
    h = tv.hashes(codes, begin, end)
    cut = np.append(np.searchsorted(begin, starts), len(begin))
    text = np.repeat(np.arange(len(texts)), np.diff(cut))
    at = np.flatnonzero(text[:-1] == text[1:]) if len(h) else np.zeros(0, np.int64)
    return tv.mix(h[at] * tv.POWERS[1] + h[at + 1]), np.concatenate(([0], np.cumsum(np.maximum(np.diff(cut) - 1, 0)))), begin[at], end[at + 1], starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, which of them are numbers, and each text's first (one more at the end)."""
    codes, starts = tv.points(texts)
    codes = tv.lower(codes)
    kind = tv.classes()[codes]
    begin, end = tv.spans((kind == tv.LETTER) | (kind == tv.NUMBER))
    return tv.hashes(codes, begin, end), kind[begin] == tv.NUMBER, np.append(np.searchsorted(begin, starts), len(begin))


@cache
def told_words() -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([" ".join(TELLING)])[0], word_hashes([" ".join(BEFORE_VERSION)])[0]


def signs(words: np.ndarray, number: np.ndarray) -> tuple[frozenset[int], frozenset[int], frozenset[int]]:
    """The telling words of a passage, the words after "version", and its numbers."""
    telling, before = told_words()
    after = words[1:][np.isin(words[:-1], before)] if len(words) else words
    return frozenset(words[np.isin(words, telling)].tolist()), frozenset(after.tolist()), frozenset(words[number].tolist())


def told_apart(own: tuple[frozenset[int], frozenset[int], frozenset[int]], passage: tuple[frozenset[int], frozenset[int], frozenset[int]], short: bool) -> bool:
    """Whether a passage that is like a template can be the template's licence, and not a sibling of it."""
    return own[0] == passage[0] and own[1] == passage[1] and (not short or own[2] <= passage[2])


def library(templates: list[tuple[str, str]]) -> Library:
    g, cut, *_ = bigrams([t for _, t in templates])
    grams = [np.unique(g[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    words, number, edge = word_hashes([t for _, t in templates])
    marks = [signs(words[a:b], number[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return Library([n for n, _ in templates], np.diff(cut), grams, np.unique(g), marks)


def dice(grams: np.ndarray, template: tuple[np.ndarray, np.ndarray], size: int) -> float:
    """2 |common| / (|a| + |b|) over multisets of bigrams."""
    found, times = np.unique(grams, return_counts=True)
    _, i, j = np.intersect1d(found, template[0], assume_unique=True, return_indices=True)
    return 2 * float(np.minimum(times[i], template[1][j]).sum()) / (len(grams) + size)


def best_end(at: np.ndarray, code: np.ndarray, times: np.ndarray, size: int) -> tuple[float, int]:
    """Best Dice of the passages that begin at the first of these shared bigrams and end after one of them, and the end; of equals the longest.

    at: places; code: which of the template's distinct bigrams each is; times: how often the template has each.
    """
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    before = np.empty(len(code), np.int64)
    before[order] = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    score = 2 * np.cumsum(before < times[code]) / (at - at[0] + 1 + size)
    k = len(score) - 1 - int(score[::-1].argmax())
    return float(score[k]), int(at[k]) + 1


def passages(grams: np.ndarray, known: Library, least: float, words: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, float, int, int]]:
    """(name, Dice, first bigram, end) of the passages of one text that match, best first in what overlaps, then in order.

    words: the text's words (hashes, and which are numbers); with them a
    passage that another licence's telling words stand in is refused.
    """
    hits = np.flatnonzero(np.isin(grams, known.every))
    found: list[tuple[float, int, int, str]] = []
    if len(hits):
        own = grams[hits]
        for name, size, template, mark in zip(known.names, known.sizes.tolist(), known.grams, known.signs, strict=True):
            short = least / (2 - least) * size
            if len(grams) < short or len(hits) < short:  # no passage can be long enough, or share enough
                continue
            at = hits[np.isin(own, template[0])]
            if len(at) < short:
                continue
            # of a longer passage even the whole template is too small a share
            until = np.searchsorted(at, at + int((2 - least) / least * size + 1e-9))
            code = np.searchsorted(template[0], grams[at])
            for i in np.flatnonzero(until - np.arange(len(at)) >= short):
                score, end = best_end(at[i : until[i]], code[i : until[i]], template[1], size)
                if score >= least and (words is None or told_apart(mark, signs(words[0][at[i] : end + 1], words[1][at[i] : end + 1]), size < NAME_WORDS)):
                    found.append((score, int(at[i]), end, name))
    out: list[tuple[int, int, str, float]] = []  # disjoint, in order of place
    for score, a, b, name in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        k = bisect_left(out, (a,))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b, name, score))
    return [(name, score, a, b) for a, b, name, score in out]


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license (best match, null if none), score, and matches (array of license, score, begin, end) of every whole text.

    Places are in code points. Of passages that overlap the better one stays,
    then the longer, the earlier, the name that comes first. A passage that
    holds telling words or a version that the template lacks, or lacks its
    own, is no match, however like it is. Null and empty
    texts match nothing; repeated rows are kept.
    """
    ready(docs.sparkSession)
    match = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(templates)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[list[dict]] = []
            for a, b in chunks(texts):
                g, cut, begin, end, starts = bigrams(texts[a:b])
                h, number, edge = word_hashes(texts[a:b])
                some = np.add.reduceat(np.append(np.isin(g, known.every), False).astype(np.int64), np.minimum(cut[:-1], len(g))) * (np.diff(cut) > 0)
                for i in range(b - a):
                    lo, hi = cut[i], cut[i + 1]
                    got = passages(g[lo:hi], known, least, (h[edge[i] : edge[i + 1]], number[edge[i] : edge[i + 1]])) if some[i] else []
                    rows.append([{"license": n, "score": s, "begin": int(begin[lo + x] - starts[i]), "end": int(end[lo + y - 1] - starts[i])} for n, s, x, y in got])
            best = [max(r, key=lambda x: (x["score"], x["end"] - x["begin"], -x["begin"])) if r else {} for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.get("license") for x in best], pa.string()), pa.array([x.get("score", 0.0) for x in best], pa.float64()), pa.array(rows, match)], names=["doc_id", "license", "score", "matches"])

    return clean(docs, "doc_id", "text").mapInArrow(run, "doc_id long, license string, score double, matches array<struct<license: string, score: double, begin: long, end: long>>")
