"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters, digits and other bytes above 0x7F, lower-cased.  Fingerprints are hashes of three
words in a row; of each two neighbouring ones of a template the smaller is kept, of documents all, so any four words in
common share one, and a template of three words always has its own.  The index maps a fingerprint to (template,
place).  Every diagonal of a template with hits of a document is a candidate; a sequence alignment in a band around it
counts the template's words that match in order.  Of alignments that overlap the best stays, and diagonals whose hits
it does not cover are aligned again in the words that are left, so notices that follow one another closely are a match
each.  Reported: template, share of its words matched, characters of the document covered.

Templates are of fixed size, so the index goes to every task.  Every row and whole text is read.  Null and empty texts
have no match; rows of a repeated doc_id are scanned each for itself.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import mix, prepare, row_slices, tidy, utf8_buffer, word_hashes

GRAM, BAND, COVERAGE = 3, 6, 0.7

# Notices of common licenses.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "all-rights-reserved": "All rights reserved.",
}

_KEEP = np.zeros(256, bool)
_KEEP[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KEEP[_a:_b] = True


def _grams(h: np.ndarray, rows: np.ndarray):
    """Place and hash of all fingerprints of words in order."""
    n = len(h) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams += mix(h[k : k + n] + np.uint64(k * 0x51_7C_C1_B7))
    grams = mix(grams)
    ok = rows[:n] == rows[GRAM - 1 :]
    place = np.flatnonzero(ok)
    return place, grams[place]


def _winnow(h: np.ndarray):
    """Place and hash of the kept fingerprints of a template."""
    place, g = _grams(h, np.zeros(len(h), np.int64))
    if len(g) < 2:
        return place, g
    keep = np.zeros(len(g), bool)
    keep[:-1] |= g[:-1] <= g[1:]
    keep[1:] |= g[1:] < g[:-1]
    return place[keep], g[keep]


def _hash(text: str):
    data, offsets = utf8_buffer(pa.array([text]))
    return word_hashes(np.where(_KEEP[data], data, np.uint8(32)), offsets)


class Index:
    """Fingerprint -> (template, place), as sorted arrays."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words = [_hash(v)[0] for v in templates.values()]
        hashes, owner, place = [], [], []
        for k, w in enumerate(self.words):
            p, g = _winnow(w)
            hashes.append(g), owner.append(np.full(len(g), k)), place.append(p)
        h, o, p = map(np.concatenate, (hashes, owner, place))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.place = h[order], o[order], p[order]

    def hits(self, place: np.ndarray, grams: np.ndarray):
        """(place in the document, template, place in the template) of every shared fingerprint."""
        a, b = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.owner[at], self.place[at]


def align(template: list, words: list, diagonal: int):
    """Longest common subsequence of a template and the words around a diagonal, inside the band.

    Returns matched words, first and last matched place in words; of equal ones the tightest, then the first.
    """
    m = len(template)
    width = 2 * BAND + 1
    none = (0, -1)  # matched words, first matched place
    before, found = [none] * (width + 1), (0, 0, 0, -1)
    for i in range(m):
        now, word = [none] * (width + 1), template[i]
        for k in range(width):
            j = diagonal + i + k - BAND  # place in words compared with template[i]
            here = max(before[k + 1], now[k - 1]) if k else before[1]
            if 0 <= j < len(words) and words[j] == word:
                n, first = before[k]
                mine = (n + 1, first if n else j)
                found = max(found, (mine[0], mine[1] - j, -j, mine[1]))
                here = max(here, mine)
            now[k] = here
        before = now
    return found[0], found[3], -found[2]


def notices(template: list, words, at: np.ndarray, diagonals: np.ndarray, lo: int, hi: int, coverage: float):
    """(matched words, first, last place) of a template's matches in words[lo:hi], none of which overlap.

    at, diagonals: places of the hits and their diagonals, sorted by diagonal.
    """
    least, queue, taken = coverage * len(template), [], []

    def offer(diagonal: int, hits: list, a: int, b: int):
        """Aligns a diagonal with hits left inside words[a:b]."""
        matched, x, y = align(template, words[a:b].tolist(), diagonal - a)
        if matched and matched >= least:
            heapq.heappush(queue, (-matched, y - x, a + x, a + y, diagonal, hits, a, b))

    cuts = np.flatnonzero(np.r_[True, diagonals[1:] != diagonals[:-1]])
    for c, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        d = int(diagonals[c])
        offer(d, at[c:e].tolist(), max(lo, d - BAND), min(hi, d + len(template) + BAND))
    while queue:
        matched, _, x, y, d, hits, a, b = heapq.heappop(queue)
        k = bisect.bisect_right(taken, (x, y))
        crossed = [t for t in taken[max(0, k - 1) : k + 1] if t[0] <= y and x <= t[1]]
        if not crossed:
            bisect.insort(taken, (x, y))
            yield -matched, x, y
            crossed = [(x, y)]
        # what is left of the words on either side, where hits are left
        for p, q in ((a, crossed[0][0]), (crossed[0][1] + 1, b)):
            left = [h for h in hits if p <= h and h + GRAM <= q]
            if left:
                offer(d, left, p, q)


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, coverage, start, stop): matches in docs (doc_id, text); character offsets, stop exclusive."""
    prepare(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index())

    def run(batches):
        own = index.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8_buffer(batch.column(1))
            out = {"doc_id": [], "template": [], "coverage": [], "start": [], "stop": []}
            for i, j in row_slices(offsets):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                clean = np.where(_KEEP[part], part, np.uint8(32))
                h, rows = word_hashes(clean, cuts)
                place, grams = _grams(h, rows)
                at, which, inside = own.hits(place, grams)
                if not len(at):
                    continue
                space = clean == 32
                first = np.r_[True, space[:-1]] & ~space
                first[cuts[:-1][cuts[:-1] < len(part)]] = True
                starts = np.flatnonzero(first & ~space)
                begin = np.searchsorted(rows, np.arange(j - i + 1))
                order = np.lexsort((at - inside, which, rows[at]))
                at, which, diagonal = at[order], which[order], (at - inside)[order]
                owner = rows[at]
                new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])])
                for c, e in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                    r, k = int(owner[c]), int(which[c])
                    template = own.words[k].tolist()
                    raw = part[cuts[r] : cuts[r + 1]]
                    chars = lambda upto: int(np.count_nonzero((raw[:upto] & 0xC0) != 0x80))
                    for matched, x, y in notices(template, h, at[c:e], diagonal[c:e], int(begin[r]), int(begin[r + 1]), coverage):
                        a, b = int(starts[x] - cuts[r]), int(starts[y] - cuts[r])
                        while b < len(raw) and _KEEP[raw[b]]:
                            b += 1
                        for name, v in zip(out, (ids[i + r], own.names[k], matched / len(template), chars(a), chars(b))):
                            out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidy(run), "doc_id long, template string, coverage double, start long, stop long")
