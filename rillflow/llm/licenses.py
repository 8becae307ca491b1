"""License scans: winnowed fingerprints of templates pick candidates, banded alignment decides.

Each template's words give hashes of ``K`` consecutive words; winnowing keeps the smallest of every
``WINNOW`` consecutive ones. The kept fingerprints form an inverted index (hash to template and
place), broadcast, as its size depends on the templates alone. Every hash of a document is looked up,
so a kept fingerprint is found wherever it stands. Hits of one template on neighbouring diagonals form a
candidate, and the template is aligned with the words there within ``BAND`` words of the diagonal (a
third of its length, if that is less, so that a short notice and its repetition stay apart). The
matched share of the template is its coverage; candidates of ``COVER`` or more are reported with the
span of their matched words, in code points.

A template of fewer than ``K`` words is one fingerprint of all its words, and must occur whole; one without words never occurs.

Defined cases: null and empty texts have no matches; repeated documents are scanned each; rows with a
null doc_id are kept; of overlapping candidates of one template the one of higher coverage stays (ties: the first); an
empty table or no templates give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common, tokens

K = 3
WINNOW = 4
BAND = 8
COVER = 0.8
_BITS = 20

# Public license notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-3-clause-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def winnowed(hashes: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the smallest hash (the last of equals) of every ``window`` consecutive ones."""
    n = len(hashes)
    if n <= window:
        return [n - 1 - int(hashes[::-1].argmin())] if n else []
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return sorted({int(n - 1 - (i + k)) for i, k in enumerate(view.argmin(axis=1))})


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [tokens.words_of(templates[n]) for n in self.names]
        self.band = [min(BAND, max(1, len(w.hash) // 3)) if len(w.hash) >= K else 0 for w in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # by number of words, then hash
        for t, w in enumerate(self.words):
            n = len(w.hash)
            h = w.windows(min(K, n))[0] if n else ()
            if n >= K:
                for p in winnowed(h):
                    self.places[int(h[p])].append((t, p))
            elif n:
                self.short[n][int(h[0])].append(t)
        self.keys = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.keys >> np.uint64(64 - _BITS)] = True
        self.seen: dict = {}

    def candidates(self, w: tokens.Words) -> Iterator[tuple[int, int, int]]:
        """(document, template, first word if aligned whole) of each group of hits on neighbouring diagonals."""
        h, whole = w.windows(K)
        at = np.flatnonzero(self.map[h >> np.uint64(64 - _BITS)] & whole)
        hits = [(int(w.doc[i]), t, int(i) - p) for i in at for t, p in self.places.get(int(h[i]), ())]
        for n, held in self.short.items():
            h, whole = w.windows(n)
            at = np.flatnonzero(np.isin(h, np.fromiter(held, np.uint64, len(held))) & whole)
            hits += [(int(w.doc[i]), t, int(i)) for i in at for t in held[int(h[i])]]
        hits.sort()
        last = None
        for doc, t, diagonal in hits:
            if last is None or last[:2] != (doc, t) or diagonal - last[2] > self.band[t] or len(self.words[t].hash) < K:
                yield doc, t, diagonal
                last = (doc, t, diagonal)

    def align(self, t: int, words: np.ndarray) -> tuple[int, int, int]:
        """Matched words, first and past-the-last matched word in ``words``, which start a band before the diagonal."""
        key = (t, words.tobytes())
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[key] = _banded(self.words[t].hash, words, self.band[t])
        return self.seen[key]


def _banded(template: np.ndarray, words: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence within ``band`` places of the diagonal, by most matches, then shortest span."""
    width = 2 * band + 1
    padded = np.zeros(len(template) + width, np.uint64)
    padded[: len(words)] = words[: len(padded)]
    real = np.zeros(len(padded), bool)
    real[: len(words)] = True
    none = (0, 0, 0)  # matches, minus the first matched word, past the last
    row = [none] * (width + 1)
    for i, value in enumerate(template):
        same = (padded[i : i + width] == value) & real[i : i + width]
        new = [none] * (width + 1)
        for d in range(width):
            j = i + d
            best = max(row[d + 1], new[d - 1] if d else none, key=lambda x: (x[0], x[1] - x[2]))
            if same[d]:
                m = row[d]
                one = (m[0] + 1, m[1] if m[0] else -j, j + 1)
                best = max(best, one, key=lambda x: (x[0], x[1] - x[2]))
            new[d] = best
        row = new
    best = max(row[:width], key=lambda x: (x[0], x[1] - x[2]))
    return best[0], -best[1], best[2]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """doc_id, license_id, coverage, start and end (code points) of every match."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, _, buf, offsets in tokens.chunks(batch.column(1)):
                w = tokens.Words(buf, offsets)
                first = np.searchsorted(w.doc, np.arange(len(offsets)))
                found: dict[tuple[int, int], list] = defaultdict(list)
                for doc, t, diagonal in index.candidates(w):
                    band = index.band[t]
                    a = max(int(first[doc]), diagonal - band)
                    b = min(int(first[doc + 1]), diagonal + len(index.words[t].hash) + band)
                    lead = a - (diagonal - band)
                    part = np.concatenate([np.zeros(lead, np.uint64), w.hash[a:b]])
                    n, x, y = index.align(t, part)
                    if n / len(index.words[t].hash) >= cover:
                        found[doc, t].append((n / len(index.words[t].hash), x + diagonal - band, y + diagonal - band))
                points, counted = None, -1
                for (doc, t), spans in sorted(found.items()):
                    kept: list[tuple[float, int, int]] = []
                    if doc != counted:  # code points before each byte of the document
                        counted, points = doc, np.r_[0, np.cumsum((buf[offsets[doc] : offsets[doc + 1]] & 0xC0) != 0x80)]
                    for c, x, y in sorted(spans, key=lambda s: (-s[0], s[1])):
                        spot = bisect(kept, x, key=lambda s: s[1])
                        if (spot == 0 or kept[spot - 1][2] <= x) and (spot == len(kept) or y <= kept[spot][1]):
                            kept.insert(spot, (c, x, y))
                    for c, x, y in kept:
                        cut = [int(points[k - offsets[doc]]) for k in (w.start[x], w.end[y - 1])]
                        out.append((ids[i + doc], index.names[t], c, *cut))
            if out:
                kind = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kind)], names=["doc_id", "license_id", "coverage", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.in_arrow(rows, run, "doc_id long, license_id string, coverage double, start long, end long")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
