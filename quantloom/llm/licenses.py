"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; the winnowed hashes of their K-word grams form an inverted index. Each text's
grams are winnowed alike; an index hit is a seed (template, place in the text less place in the template).
Every seed diagonal is a candidate, and a banded alignment of the template with the text around it
gives the words matched, the coverage of the template and the span in the text. A candidate that a taken match
overlaps is aligned anew with the words that are left, so that statements next to each other are all found.

Words outside all templates can't be part of a gram of the index, so such grams count as the greatest hash:
every gram that winnowing a template selects within a stretch is still selected in a text that holds it.

Edge cases: null and empty texts, and texts without a match, give a row without findings; repeated rows get
equal rows; of overlapping matches that of most words stays, then of greater coverage, then of the earliest start; empty
tables give empty results; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a gram, grams of a winnowing window, words that an alignment may drift, least coverage of a template.
K, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.8
_WORD = re.compile(r"[^\W_]+")

# Notices and short statements of public licenses, by identifier.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


class Match(NamedTuple):
    license: str
    start: int
    end: int
    #: Words of the template that the text holds in order, and their share of the template.
    words: int
    coverage: float


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window of grams, the rightmost among equals."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


class Index:
    """Vocabulary, template words and the inverted index of winnowed grams."""

    def __init__(self, templates: list[tuple[str, str]], k: int = K) -> None:
        self.k = k
        self.number: dict[str, int] = {}
        self.names = [name for name, _ in templates]
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in _WORD.findall(t.lower())], np.int64) for _, t in templates]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            h = self.grams(w)
            for p in winnow(h).tolist():
                self.places[int(h[p])].append((i, p))
        self.hashes = np.array(sorted(self.places), np.uint64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Hashes of the grams of word numbers; a gram with an unknown word (0) has the greatest."""
        n = len(numbers) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(self.k):
            part = numbers[i : i + n]
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            known &= part > 0
        h ^= h >> np.uint64(29)
        return np.where(known, h, np.uint64(0xFFFFFFFFFFFFFFFF))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(words matched, first, last+1 in text) of the best alignment in a band around text place = template place + shift.

    A match counts 2, a word left out on either side -1; the ends of both are free. Words below 0 are taken, no
    alignment reaches over them. Of equal alignments that whose end is nearest to the shift's own diagonal is taken.
    """
    width = 2 * band + 1
    score = [0] * width
    first = [-1] * width
    count = [0] * width
    best, far = (0, 0, 0, 0), width
    for i, w in enumerate(template.tolist()):
        new, nf, nc = [0] * width, [-1] * width, [0] * width
        for d in range(width):
            j = i + shift + d - band
            s, f, c = 0, -1, 0
            if 0 <= j < len(text) and text[j] < 0:
                continue
            if 0 <= j < len(text) and text[j] == w:
                s, f, c = score[d] + 2, first[d] if first[d] >= 0 else j, count[d] + 1
            # d + 1 of the row above: this template word is left out; d - 1 of this row: this text word is.
            if d + 1 < width and score[d + 1] - 1 > s:
                s, f, c = score[d + 1] - 1, first[d + 1], count[d + 1]
            if d and new[d - 1] - 1 > s:
                s, f, c = new[d - 1] - 1, nf[d - 1], nc[d - 1]
            if score[d] - 1 > s:  # one on each side
                s, f, c = score[d] - 1, first[d], count[d]
            new[d], nf[d], nc[d] = s, f, c
            if s > best[0] or s and s == best[0] and abs(d - band) < far:
                best, far = (s, c, f, j + 1), abs(d - band)
        score, first, count = new, nf, nc
    return best[1:]


def scan_text(text: str, index: Index, least: float = COVERAGE) -> list[Match]:
    """Matches of all templates, by start, license and end."""
    get = index.number.get
    plain = text.lower()
    if len(plain) != len(text):  # a few letters become two in lower case: these stay
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = [get(w, 0) for w in _WORD.findall(plain)]
    if len(words) < index.k:
        return []
    numbers = np.array(words, np.int64)
    h = index.grams(numbers)
    hit = np.nonzero(np.isin(h, index.hashes))[0]
    if not len(hit):
        return []
    chosen = winnow(h)
    seeds: dict[int, set[int]] = defaultdict(set)
    for p in hit[np.isin(hit, chosen)].tolist():
        for t, q in index.places[int(h[p])]:
            seeds[t].add(p - q)
    #: Candidates, the best first: most words, then coverage, then the earliest start.
    found: list[tuple[int, float, int, int, int, int]] = []

    def candidate(t: int, s: int) -> None:
        size, at = len(index.words[t]), max(0, s - BAND)
        near = numbers[at : s + size + BAND + 1]
        if np.count_nonzero(near > 0) < least * size:
            return
        n, a, b = align(index.words[t], near, s - at)
        if n and n >= least * size:
            heapq.heappush(found, (-n, -n / size, a + at, t, b + at, s))

    for t, shifts in seeds.items():
        for s in sorted(shifts):
            candidate(t, s)
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(plain)]
    out: list[Match] = []
    while found:
        n, coverage, a, t, b, s = heapq.heappop(found)
        if (numbers[a:b] < 0).any():
            candidate(t, s)
            continue
        out.append(Match(index.names[t], spans[a][0], spans[b - 1][1], -n, -coverage))
        numbers[a:b] = -1
    return sorted(out, key=lambda m: (m.start, m.license, m.end))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches): the matches of every row. Templates are a parameter of the job, not data that grows with it."""
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("coverage", pa.float64())]))
        index = Index(given)
        for b in batches:
            got = [[m._asdict() for m in scan_text(t.as_py() or "", index, least)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["doc_id", "matches"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, matches array<struct<license:string,start:int,end:int,words:int,coverage:double>>")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licenses, coverage, spans) of every document; licenses and spans are comma-joined."""
    span = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["words"].cast("string"))
    return scan(docs).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("matches.coverage")), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("matches", span), ",").alias("spans"),
    )
